import random

import numpy as np
import pyarrow as pa
from helpers import documents, sentence
from pyspark.sql import functions as F

from logloom.llm import ann, langid, quality
from logloom.llm.ann import search


def test_language_held_out(spark):
    r = random.Random(1)
    letters = {"aa": "abcdefgh", "bb": "hijklmnop", "cc": "qrstuvwxyz"}
    given = [(i, " ".join("".join(r.choice(letters[x]) for _ in range(5)) for _ in range(30)), x) for i, x in enumerate(r.choice(list(letters)) for _ in range(300))]
    out = langid.identify(spark.createDataFrame(given, "doc_id long, text string, lang string")).collect()
    truth = {i: x for i, _, x in given}
    held = [o for o in out if o["held_out"]]
    assert len(held) > 30 and np.mean([o["lang_pred"] == truth[o["doc_id"]] for o in held]) > 0.98
    assert all(0 <= o["score"] <= 1 for o in out)


def test_language_by_order_of_characters(spark):
    # Two languages of the same 3-byte characters, whose first two bytes are equal: only their order tells.
    r = random.Random(5)
    step = {"up": 1, "down": -1}
    given = [(i, "".join(chr(0x5100 + (at + j * step[x]) % 48) for at in [r.randrange(48)] for j in range(96)), x) for i, x in enumerate(r.choice(list(step)) for _ in range(200))]
    out = langid.identify(spark.createDataFrame(given, "doc_id long, text string, lang string")).filter("held_out").collect()
    assert len(out) > 20 and all(o["lang_pred"] == given[o["doc_id"]][2] for o in out)


def test_characters():
    rows = ["aÀЖ日\U0001f600Z", "", "ascii", "Я"]
    raw = [t.encode() for t in rows]
    code, edges = langid.characters(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert ["".join(map(chr, code[a:b].tolist())) for a, b in zip(edges, edges[1:])] == [t.lower() for t in rows]


def test_language_edges(spark):
    out = langid.identify(documents(spark)).collect()
    assert len(out) == documents(spark).count()
    by_id = {o["doc_id"]: o for o in out if o["doc_id"] is not None}
    for i in (11, 12, 13, 17):
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0
    assert langid.identify(documents(spark, [])).count() == 0
    none = langid.identify(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {o["lang_pred"] for o in none} == {"und"}
    kept = langid.in_known_language(documents(spark))
    assert kept.columns == documents(spark).columns and 11 not in [r["doc_id"] for r in kept.collect()]


def test_language_by_force(spark):
    # Counts, log probabilities and posteriors with plain numbers.
    import math
    from collections import Counter
    from zlib import crc32

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 % 2**64
        h ^= h >> 27
        h = h * 0x94D049BB133111EB % 2**64
        return h ^ h >> 31

    def grams(text):
        low = [c.lower() if len(c.lower()) == 1 else c for c in text]
        out = Counter()
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                packed = 0
                for c in low[i : i + n]:
                    packed = (packed << 21 | ord(c)) % 2**64
                out[mix(packed ^ n * 0x9E3779B97F4A7C15 % 2**64) >> 48] += 1
        return out

    given = [(r["doc_id"], r["text"], r["lang"]) for r in documents(spark).collect()]
    learned = [(t, x) for d, t, x in given if d is not None and t is not None and x is not None and crc32(str(d).encode()) % 5 != 0]
    languages = sorted({x for _, x in learned})
    counts = {x: sum((grams(t) for t, y in learned if y == x), Counter()) for x in languages}
    got = sorted(langid.identify(documents(spark)).collect(), key=repr)
    want = []
    for d, t, _ in given:
        held = d is not None and crc32(str(d).encode()) % 5 == 0
        if not any(c.isalpha() for c in t or ""):
            want.append((d, held, "und", 0.0))
            continue
        total = []
        for x in languages:
            all_of = sum(counts[x].values()) + 0.5 * 2**16
            total.append(math.log(sum(y == x for _, y in learned) / len(learned)) + sum(n * math.log((counts[x][b] + 0.5) / all_of) for b, n in grams(t).items()))
        best = max(range(len(total)), key=lambda i: total[i])
        want.append((d, held, languages[best], 1 / sum(math.exp(v - total[best]) for v in total)))
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert (g["doc_id"], g["held_out"], g["lang_pred"]) == w[:3] and abs(g["score"] - w[3]) < 1e-4


def test_language_and_quality_in_parts(monkeypatch):
    # What a long text adds up to in parts is what it adds up to at once.
    from logloom.llm import textbatch as tb

    r = random.Random(11)
    text = "".join(r.choice(["word", " ", "日本", "é", "\U0001f600", "A1!", "  "]) for _ in range(900))
    data, edges = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    sums = lambda pairs: [np.bincount(np.concatenate([k for i, (k, _) in enumerate(pairs) if i % 3 == n]), minlength=1 << 16).tolist() for n in range(3)]
    whole, features = sums(list(langid.grams_in_parts(data, edges, 16))), quality.features(data, edges)
    monkeypatch.setattr(langid, "SLICE_BYTES", 100)
    monkeypatch.setattr(tb, "SLICE_BYTES", 100)
    pairs = list(langid.grams_in_parts(data, edges, 16))
    assert len(pairs) > 60 and sums(pairs) == whole
    assert all(np.allclose(a, b) for a, b in zip(features, quality.features(data, edges), strict=True))


def test_more_languages_than_full_buckets(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_CELLS", 1 << 12)
    given = [(i, chr(0x4E00 + i % 40) * 20, f"l{i % 40:02}") for i in range(400)]
    model = langid.fit(spark.createDataFrame(given, "doc_id long, text string, lang string"), F.lit(True))
    assert len(model.languages) == 40 and model.grams.size <= 1 << 12
    out = langid.predict(spark.createDataFrame(given, "doc_id long, text string, lang string"), model).collect()
    assert np.mean([o["lang_pred"] == given[o["doc_id"]][2] for o in out]) > 0.9


def rated(seed=3, rows=40):
    r = np.random.default_rng(seed)
    row = np.repeat(np.arange(rows), 6)
    return quality._Rated(row, r.integers(0, quality._WIDTH, len(row)), r.random(len(row)), r.integers(0, 3, rows), 3)


def test_quality_loss_by_force():
    # The mean of -log(P(grade)), with P by sigmoids of plain numbers, and its slope by differences.
    import math

    x, r = rated(), np.random.default_rng(4)
    p = x.start()
    p[: quality._WIDTH] += r.normal(0, 1, quality._WIDTH)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    first, second = p[quality._WIDTH], p[quality._WIDTH] + math.exp(p[quality._WIDTH + 1])

    def chance(i):
        z = sum(p[c] * v for w, c, v in zip(x.row, x.column, x.value) if w == i)
        above = [1.0, 1 - sigmoid(first - z), 1 - sigmoid(second - z), 0.0]
        return above[x.grade[i]] - above[x.grade[i] + 1]

    loss, slope = x.loss(p, True)
    assert abs(loss + sum(math.log(chance(i)) for i in range(40)) / 40) < 1e-9
    for j in [*x.column[:8].tolist(), quality._WIDTH, quality._WIDTH + 1]:
        d = np.zeros_like(p)
        d[j] = 1e-5
        assert abs((x.loss(p + d, False)[0] - x.loss(p - d, False)[0]) / 2e-5 - slope[j]) < 1e-7


def test_quality_penalty_leaves_out_what_tells_nothing():
    # One column tells the grade, hundreds of others are noise: only few get a weight.
    r = np.random.default_rng(6)
    grade = r.integers(0, 3, 300)
    row = np.repeat(np.arange(300), 31)
    column = np.concatenate([[g, *(10 + r.integers(0, 400, 30))] for g in grade])
    model = quality._fitted(quality._Rated(row, column, np.full(len(row), 0.3), grade, 3), 60)
    assert model.weights[0] < 0 < model.weights[2] and (np.abs(model.weights[10:]) > 0.1 * abs(model.weights[2])).sum() < 40


def test_quality(spark):
    r = random.Random(2)
    docs, labels, vocabulary = [], [], sentence(0, 300).split()
    for i in range(600):
        grade = r.randrange(3)
        text = " ".join(r.choice(vocabulary) for _ in range(60))
        if grade == 0:
            text += " vile" * 2
        elif grade == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text))
        labels.append((i, None if i % 50 == 0 else int(grade != 1), int(grade == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    ratings = quality.ratings_of(spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int"))
    for model in (quality.fit(d, ratings, 3), quality.fit(d, ratings, 3, steps=120)):  # as the query fits it, and longer
        out = {o["doc_id"]: o for o in quality.grade(d, model, 2).collect()}
        new = [(out[i]["selected"], labels[i][1] == 1 and labels[i][2] == 0) for i in range(400, 600) if labels[i][1] is not None]
        assert np.mean([a == b for a, b in new]) > 0.9
    out = {o["doc_id"]: o for o in quality.grade(d, model, 2).collect()}
    new = [(out[i]["selected"], labels[i][1] == 1 and labels[i][2] == 0) for i in range(400, 600) if labels[i][1] is not None]
    assert np.mean([a == b for a, b in new]) > 0.9
    assert all(0 <= o["expected_grade"] <= 2 for o in out.values())
    assert quality.grade(documents(spark), model, 2).count() == documents(spark).count()
    assert quality.grade(documents(spark, []), model, 2).count() == 0


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(documents(spark), quality.ratings_of(none), 3)
    assert model is None and all(o["selected"] for o in quality.grade(documents(spark), model, 2).collect())


def exact(ids, x, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = unit @ unit[ids.index(q)]
        out[q] = [ids[i] for i in sorted(range(len(ids)), key=lambda i: (-round(s[i], 12), ids[i])) if ids[i] != q][:k]
    return out


def test_neighbours_recall(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 32))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for row in search(v, F.col("vec_id") % 50 == 0, least=256).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    want = exact(list(range(4000)), x, range(0, 4000, 50), 5)
    assert np.mean([len({b for _, b, _ in got[q]} & set(want[q])) / 5 for q in want]) >= 0.9
    assert all([a for a, _, _ in sorted(g)] == [1, 2, 3, 4, 5] for g in got.values())


def test_neighbours_recall_of_many(spark):
    # 50,000 vectors without any groups, with the defaults of the query, against brute force.
    r = np.random.default_rng(13)
    x = r.normal(size=(50_000, 32))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 32).cast(pa.list_(pa.float64()))
    v = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": lists})).repartition(4)
    asked = list(range(0, 50_000, 500))
    got = {}
    for row in search(v, F.col("vec_id") % 500 == 0).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit[asked] @ unit.T
    scores[np.arange(len(asked)), asked] = -2
    nearest = np.argsort(-scores, axis=1)[:, :5]
    assert np.mean([len(got[q] & set(n.tolist())) / 5 for q, n in zip(asked, nearest)]) >= 0.9


def test_share_is_small_among_groups():
    r = np.random.default_rng(14)
    spread = ann._units(r.normal(size=(2000, 24)))
    centres = r.normal(size=(100, 24))
    grouped = ann._units(np.repeat(centres, 20, axis=0) + 0.05 * r.normal(size=(2000, 24)))
    shares = [ann.share_for(0.97, x[::8], np.delete(x, np.s_[::8], 0), 32, 5) for x in (grouped, spread)]
    assert shares[0] < 0.05 < shares[1] < 0.6


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    got = search(v, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r[0], r[1], r[2], round(r[3], 12)) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_neighbours_beside_repeated_ids(spark):
    # Ten copies of one vec_id near the query, in one block: they count once.
    rows = [(0, [1.0, 0.0, 0.0]), *[(1, [1.0, 0.01, 0.0])] * 10, *[(i, [1.0, 0.1 * i, 0.0]) for i in range(2, 9)]]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    assert [r["vec_id"] for r in search(v, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_repeated_ids_take_one_place_each():
    # 40 copies near the query would take all of least=20 places; the ids behind them are still candidates.
    r = np.random.default_rng(4)
    far = r.normal(size=(60, 8))
    x = np.concatenate((np.tile([1.0, *[0.0] * 7], (40, 1)), far))
    ids = np.concatenate((np.ones(40, np.int64), np.arange(2, 62)))
    pivots = ann._units(r.normal(size=(16, 8)))
    orders = ann._orders(x, pivots, 8)
    flat = orders.reshape(-1)
    by = np.argsort(flat, kind="stable")
    edges = np.searchsorted(flat[by], np.arange(17))
    row = {"ids": ids.tobytes(), "vectors": x.tobytes(), "edges": edges.tobytes(), "rows": (by // 8).astype(np.int32).tobytes(), "ranks": (by % 8).astype(np.int16).tobytes()}
    q = np.array([[1.0, *[0.0] * 7]])
    ((_, found, score),) = ann._search_block(np.array([0]), q, ann._orders(q, pivots, 8), row, 5, 0.1, 20)
    assert found[0] == 1 and len(set(found.tolist())) == 5 and (np.diff(score) <= 0).all()


def test_neighbours_of_extreme_vectors(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(60, 5)) * 10.0 ** r.choice([-300, -200, 0, 200, 300], size=(60, 1))
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    want = exact(list(range(60)), unit, [0, 1, 2], 4)
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") < 3, k=4)
    found = {}
    for row in got.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append(row["vec_id"])
        assert abs(row["score"]) <= 1 + 1e-9
    assert found == want
