import re

import pyarrow as pa
import pytest
from helpers import documents, fold, multiset, rows, sentence

from logloom.llm.decontam import decontaminate, find_leaks


def benchmark(spark):
    shared = sentence(2, 60).split()
    items = [(1, " ".join(shared[10:30]).upper()), (2, "tail"), (3, "never seen anywhere at all"), (None, "one"), (4, None), (5, "two-words"), (11, " ".join(shared[20:30]))]
    return spark.createDataFrame(items, "item_id long, text string"), items


def by_force(given, items, n):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    out = []
    for d, t in given:
        w, hit, found = split(t), set(), set()
        for i, text in items:
            x = split(text)
            k = min(n, len(x))
            if i is None or k == 0:
                continue
            grams = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in grams:
                    hit |= set(range(j, j + k))
                    found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [10**6, 0])
def test_leaks(spark, most):
    bench, items = benchmark(spark)
    want = by_force([(r[0], r[1]) for r in rows()], items, 10)
    got = find_leaks(documents(spark), bench, 10, most)
    assert multiset(got, "doc_id", "n_words", "n_hit", "item_ids") == want
    assert sum(w[2] for w in want) > 30


@pytest.mark.parametrize("most", [10**6, 0])
def test_actions(spark, most):
    bench, _ = benchmark(spark)
    docs = documents(spark).selectExpr("*", "1 as d", "2 as _d", "3 as t", "4 as _t", "5 as s", "6 as _s")
    left = decontaminate(docs, bench, most_broadcast=most)
    assert left.columns == docs.columns and not {3, 4, 10, 15} & {r["doc_id"] for r in left.collect()} and left.filter("text is null").count() == 2
    cut = decontaminate(docs, bench, action="spans", most_broadcast=most)
    assert cut.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.count() == docs.count() and texts[15] == "" and texts[0] == rows()[0][1] and find_leaks(cut, bench).filter("n_hit > 0").count() == 0


def test_empty(spark):
    bench, _ = benchmark(spark)
    assert find_leaks(documents(spark, []), bench).count() == 0
    assert find_leaks(documents(spark), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_long_texts_in_parts(spark, monkeypatch):
    from logloom.llm import decontam
    from logloom.llm import textbatch as tb

    monkeypatch.setattr(tb, "SLICE_BYTES", 300)
    bench, items = benchmark(spark)
    index = decontam._Index.of(decontam.windows(bench, 10).collect())
    for d, t in [(r[0], r[1]) for r in rows() if r[1]]:
        data, offsets = tb.flat(pa.array([t]))
        counts, found = decontam._found(index, data, offsets)
        hit = decontam._covered((h.first, h.first + h.n) for h in found[0])
        assert [(d, int(counts[0]), hit, sorted({i for h in found[0] for i in index.items[h.words]}))] == by_force([(d, t)], items, 10)
