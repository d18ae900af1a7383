
import random
from collections import Counter, defaultdict

from helpers import documents, fold, multiset, rows, sentence, words

from logloom.llm.fm_dedup import FMIndex, drop_repeated_word_spans, repeated_windows
from logloom.llm import minhash
from logloom.llm.line_dedup import LineRuns, drop_repeated_lines, without_repeated_lines
from logloom.llm.minhash import keep_one, near_duplicates
from logloom.llm.suffix_dedup import drop_repeated_substrings



def byte_spans(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def test_substrings(spark):
    given = rows()
    want = sorted(((r[0], *w) for r, w in zip(given, byte_spans([r[1] for r in given], 200))), key=repr)
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in drop_repeated_substrings(documents(spark)).collect()), key=repr)
    assert got == want


def test_substrings_small_window_random(spark):
    r = random.Random(5)
    given = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 60))) + ("xyzzyplughfrobozz" * r.randint(0, 3))) for i in range(60)]
    want = sorted((i, *w) for (i, _), w in zip(given, byte_spans([t for _, t in given], 16)))
    got = drop_repeated_substrings(spark.createDataFrame(given, "doc_id long, text string"), window=16, gram=6)
    assert sorted((x[0], x[1], x[2], x[3], bytes(x[4])) for x in got.collect()) == want


def word_spans(texts, window):
    docs = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_word_spans(spark):
    given = rows()
    want = sorted(((r[0], *w) for r, w in zip(given, word_spans([r[1] for r in given], 35))), key=repr)
    got = drop_repeated_word_spans(documents(spark))
    assert multiset(got, "doc_id", "n_words", "n_removed", "kept") == want


def test_word_spans_random(spark):
    r = random.Random(6)
    given = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 50)))) for i in range(80)]
    want = sorted(((i, *w) for (i, _), w in zip(given, word_spans([t for _, t in given], 9))), key=repr)
    got = drop_repeated_word_spans(spark.createDataFrame(given, "doc_id long, text string"), window=9, gram=4)
    assert multiset(got, "doc_id", "n_words", "n_removed", "kept") == want


def test_fm_index_counts():
    import numpy as np

    r = random.Random(7)
    passages = [[r.randint(1, 4) for _ in range(r.randint(5, 20))] for _ in range(30)]
    text = np.array([x for p in passages for x in [*p, 0]])
    length = np.array([len(p) for p in passages])
    start = np.cumsum(length + 1) - (length + 1)
    index = FMIndex(text, 5, 32)
    passage, offset = repeated_windows(index, text, start, length, 6)
    seen = Counter(tuple(p[i : i + 6]) for p in passages for i in range(len(p) - 5))
    want = {(k, i) for k, p in enumerate(passages) for i in range(len(p) - 5) if seen[tuple(p[i : i + 6])] > 1}
    assert set(zip(passage.tolist(), offset.tolist())) == want and len(passage) == len(want)


def lines_by_force(given, least_docs=3):
    keys = lambda t: [fold(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    held = defaultdict(set)
    for d, t in given:
        if d is not None:
            for k in keys(t):
                if len(k) >= 20:
                    held[k].add(d)
    out = []
    for d, t in given:
        lines = (t or "").split("\n")
        lost = [d is not None and len(held[k]) >= least_docs and d < max(held[k]) for k in keys(t)]
        out.append((d, len(lines), sum(lost), "\n".join(x for x, g in zip(lines, lost) if not g)))
    return sorted(out, key=repr)


def test_lines(spark):
    given = [(r[0], r[1]) for r in rows()]
    got = drop_repeated_lines(documents(spark), batches=3, fanout=2)
    assert multiset(got, "doc_id", "n_lines", "n_dropped", "kept") == lines_by_force(given)
    assert sum(x[2] for x in lines_by_force(given)) == 2


def test_line_runs(spark):
    # 6 batches of keys against counts by hand: each run has what all batches so far say of its keys, and runs merge without a shuffle.
    r = random.Random(12)
    batches = [[(d, r.randrange(400), 7) for d in range(100 * b, 100 * b + 30) for _ in range(6)] for b in range(6)]
    runs, every = LineRuns(spark, fanout=2), defaultdict(set)
    for b, rows_of in enumerate(batches):
        name = runs.add(spark.createDataFrame(rows_of, "doc_id long, k1 long, k2 long"))
        for d, k, _ in rows_of:
            every[k].add(d)
        got = {x["k1"]: (x["n_docs"], x["last_doc"]) for x in spark.table(name).collect()}
        assert got == {k: (len(every[k]), max(every[k])) for _, k, _ in rows_of}
        if b == 1:
            held = [runs._held(n, i) for i, n in enumerate(runs.runs())]
            for how in ("left", "full"):
                plan = held[0].join(held[1], ["k1", "k2"], how)._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" in plan and "Exchange" not in plan
        runs.compact()
    assert runs.merges >= 4 and len(runs.levels) >= 3
    for least in (1, 3, 5):
        assert {x["k1"]: x["last_doc"] for x in runs.heavy(least).collect()} == {k: max(d) for k, d in every.items() if len(d) >= least}
    left = runs.runs()
    runs.drop()
    assert left and not any(spark.catalog.tableExists(t) for t in left)


def test_merge_with_the_runs_decides(spark, monkeypatch):
    # Three documents in three batches share a line: without the runs no batch knows of the others.
    docs = spark.createDataFrame([(i, "a line that is long enough\nown %d" % i) for i in range(12)], "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in drop_repeated_lines(docs, batches=12, least_docs=12).collect()) == [0] + [1] * 11
    monkeypatch.setattr(LineRuns, "_held", lambda self, name, i: spark.createDataFrame([], f"k1 long, k2 long, n{i} long, d{i} long"))
    assert {r["n_dropped"] for r in drop_repeated_lines(docs, batches=12, least_docs=12, fanout=99).collect()} == {0}


def test_lines_keep_columns(spark):
    docs = documents(spark).selectExpr("*", "1 as d", "2 as t", "3 as lost", "4 as `row`", "5 as _k", "6 as _t", "7 as _lost", "8 as _lines")
    out = without_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    changed = {r["doc_id"]: r["n_chars"] for r in out.collect() if r["doc_id"] in (5, 6)}
    assert changed[5] < len(rows()[5][1]) and changed[6] < len(rows()[6][1])


def near_by_force(given, k, percent):
    def shingles(t):
        w = words(fold(t))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = {d: shingles(t) for d, t in given if d is not None}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * s >= percent * u:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates(spark):
    given = [(r[0], r[1]) for r in rows()]
    want = near_by_force(given, 3, 85)
    got = near_duplicates(documents(spark), 3, 85).collect()
    assert len(got) == len(given)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_differing_pairs_lose_none(spark):
    # Each group has a pivot; members differ from it by edits of their own and by edits that many share.
    r = random.Random(9)
    sets, groups = {}, []
    for g in range(12):
        base = [r.randrange(10**9) for _ in range(r.randint(20, 60))]
        shared = [(x, r.randrange(10**9)) for x in r.sample(base, 4)]
        pivot = len(sets)
        sets[pivot] = sorted(base)
        for _ in range(10):
            swap = dict(r.sample(shared, r.randint(0, 4)))
            one = {swap.get(x, x) if r.random() > 0.03 else r.randrange(10**9) for x in base[: r.randint(len(base) - 4, len(base))]}
            near = 100 * len(one & set(base)) >= 85 * len(one | set(base))
            groups.append((pivot, len(sets), pivot if near else len(sets), pivot))
            sets[len(sets)] = sorted(one)
    table = spark.createDataFrame(list(sets.items()), "doc_id long, set array<long>")
    members = spark.createDataFrame(groups, "pivot long, rep long, component long, home long")
    got = {(x["a"], x["b"]) for x in minhash._differing_pairs(members, table, 85).collect()}
    linked = {
        (x[1], y[1])
        for x in groups
        for y in groups
        if x[0] == y[0] and x[1] < y[1] and x[2] != y[2] and 100 * len(set(sets[x[1]]) & set(sets[y[1]])) >= 85 * len(set(sets[x[1]]) | set(sets[y[1]]))
    }
    assert len(linked) > 20 and linked <= got and len(got) < len(sets) ** 2 / 4


def test_near_duplicates_in_large_groups(spark):
    r = random.Random(8)
    given = []
    for g in range(3):
        base = sentence(100 + g, 150).split()
        for i in range(120):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = "w" + str(r.randrange(10**6))
            given.append((len(given), " ".join(w)))
    want = near_by_force(given, 3, 85)
    got = near_duplicates(spark.createDataFrame(given, "doc_id long, text string"), 3, 85)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == want


def test_near_duplicates_unite_rows_of_a_document(spark):
    # As in the SQL: the set of a document is the union over its rows, whatever their texts.
    a, b, c = (sentence(200 + i, 90) for i in range(3))
    given = [(1, a), (1, b), (2, a), (3, a + "\n" + b), (4, b), (5, c), (6, c), (6, "few words"), (7, a), (7, None), (8, None), (8, "")]
    words_of = lambda t: words(fold(t))
    sets = defaultdict(set)
    for d, t in given:
        w = words_of(t)
        sets[d] |= {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    component = {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5, 7: 2, 8: 8}
    for x, y in ((x, y) for x in sets for y in sets if x < y and sets[x]):
        assert (100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])) == (component[x] == component[y])
    got = near_duplicates(spark.createDataFrame(given, "doc_id long, text string"), 3, 85)
    want = sorted((d, len(sets[d]), component[d], component[d] == d) for d, _ in given)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_keep_one(spark):
    docs = documents(spark)
    out = keep_one(docs)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and 0 in ids and 1 not in ids and ids.count(None) == 2


def test_empty_tables(spark):
    docs = documents(spark, [])
    for f in (drop_repeated_substrings, drop_repeated_word_spans, drop_repeated_lines, near_duplicates, keep_one, without_repeated_lines):
        assert f(docs).count() == 0


def test_group_of_word_swaps_is_not_compared_in_full(spark, monkeypatch):
    # One text with 9 of 40 fixed swaps each: all share buckets, few are linked, hardly any with the pivot.
    r = random.Random(1)
    base, places = [f"w{r.randrange(10**6)}" for _ in range(300)], r.sample(range(300), 40)
    given = []
    for i in range(240):
        w = list(base)
        for p in r.sample(places, 9):
            w[p] = f"swap{p}"
        given.append((i, " ".join(w)))
    tried, measured = [], minhash._measured
    monkeypatch.setattr(minhash, "_measured", lambda pairs, sets: (tried.append(pairs.count()), measured(pairs, sets))[1])
    got = near_duplicates(spark.createDataFrame(given, "doc_id long, text string"), 3, 85)
    assert sorted(multiset(got, "doc_id", "n_shingles", "component_id")) == sorted((d, *x) for d, x in near_by_force(given, 3, 85).items())
    assert len(tried) == 3 and tried[2] < 240 * 20 and sum(tried) < 240 * 120
