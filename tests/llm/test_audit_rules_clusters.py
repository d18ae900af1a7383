import random
import re
from collections import Counter
from math import floor, log

import numpy as np
from helpers import SCHEMA, documents, fold, multiset, rows, sentence

from logloom.llm import divergence, quality_rules
from logloom.llm.balltree import BallTree, centroid_clusters, integer_vectors
from logloom.llm.divergence import divergence_audit
from logloom.llm.queries import ORACLES  # noqa: F401 - importing builds the SQL

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit(given, least_docs, most_terms):
    """Dense, from the definition."""
    docs = [((g[2] or ""), (g[3] or ""), TERM.findall(fold(g[1]))) for g in given]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least_docs)
        sources = sorted({d[1] for d in docs if d[0] == lang})
        count = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if df[t] >= least_docs) for s in sources}
        whole = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s in sources:
            pair = [(sum((p(count[s], t) - p(count[o], t)) ** 2 // p(count[o], t) for t in kept), o) for o in sources if o != s]
            term = [((p(count[s], t) - p(whole, t)) ** 2 // p(whole, t), t) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, r) for r, (v, o) in enumerate(found, 1) if part == "pair" or r <= most_terms]
    return sorted(out)


def audited(df, *args):
    return multiset(divergence_audit(df, *args), "lang", "source", "part", "item", "value", "rank")


def test_divergence_is_that_of_all_terms(spark):
    given = rows() + [rows()[5]]
    assert audited(documents(spark, given), 2, 7) == sorted(audit(given, 2, 7), key=repr)
    r = random.Random(3)
    made = [(i, " ".join(r.choice(["Ab", "ab", "été", "日本", "x9y", "q", "rare%d" % r.randint(0, 30)]) for _ in range(r.randint(0, 30))), r.choice(["en", "fr"]), r.choice("abcd")) for i in range(80)]
    got = audited(spark.createDataFrame(made, "doc_id long, text string, lang string, source string"), 3, 5)
    assert got == sorted(audit(made, 3, 5), key=repr)
    assert any(x[2] == "term" and x[5] == 5 for x in got) and not any(x[2] == "term" and x[5] > 5 for x in got)


def test_divergence_long_texts_and_no_groups_to_broadcast(spark, monkeypatch):
    made = [(i, "One two deux " * 30 + f"w{i} " + "alone" * 20, "en", f"s{i % 3}") for i in range(9)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    want = sorted(audit(made, 3, 200), key=repr)
    monkeypatch.setattr(divergence, "SMALL_GROUPS", 0)
    assert audited(df) == want
    data = ("One two deux " * 50).encode()
    parts = divergence.tb.long_parts(np.frombuffer(data, np.uint8), divergence.LETTERS, 64, 0)
    seen, df_sum, n_sum = set(), Counter(), Counter()
    for a, b in parts:
        _, term, df_, n = divergence._slice_counts(np.zeros(1, np.int64), np.frombuffer(data[a:b], np.uint8), np.array([0, b - a]), seen)
        for t, x, y in zip(term.to_pylist(), df_, n):
            df_sum[t] += int(x)
            n_sum[t] += int(y)
    assert df_sum == {b"one": 1, b"two": 1, b"deux": 1} and n_sum == {b"one": 50, b"two": 50, b"deux": 50}


def test_divergence_without_terms(spark):
    given = [(1, None, None, "a"), (2, "12 34", None, "b"), (3, "word", "en", None)]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string")
    assert audited(df) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]
    assert divergence_audit(df.limit(0)).count() == 0
    assert divergence_audit(documents(spark, []), 3).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_of_frequent_terms_leaves_no_long(spark):
    one = spark.range(1).select(divergence._share(divergence.F.lit(20_000_000_000), divergence.F.lit(50_000_000_001)).alias("p"), divergence._share(divergence.F.lit(8_000_000_000), divergence.F.lit(50_000_000_001)).alias("q")).first()
    assert one["p"] == 1 + 10**9 * 20_000_000_001 // 50_000_000_001 and one["q"] == 1 + 10**9 * 8_000_000_001 // 50_000_000_001


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def rule_texts():
    r = random.Random(11)
    out = []
    for i in range(260):
        w = sentence(i, r.randint(15, 200)).split()
        kind = r.random()
        if kind < 0.1:
            w = [x + r.choice(["###", "$$", "%&|"]) for x in w]
        elif kind < 0.2:
            w = w + w[: len(w) // 3]
        elif kind < 0.25:
            w = ["".join(w[j : j + 9]) for j in range(0, len(w), 9)] * 3
        text = " ".join(w)
        out.append((i, text.replace(" ", "\n", 3) + ("\n" + text[:20]) * r.choice([0, 0, 0, 2]), "en" if i % 4 else "fr", f"s{i % 3}"))
    return out


def mcd(x, starts_box):
    """The estimates of one group, in numpy: three starts, concentration steps, least determinant."""
    p, ridge = x.shape[1], np.diag([(r * quality_rules.STEPS) ** 2 for r in quality_rules.RIDGES])

    def of(rows):
        m = rows.sum(axis=0) / len(rows)
        return m, rows.T @ rows / len(rows) - np.outer(m, m) + ridge

    def lower_median(v):
        return np.sort(v)[(len(v) - 1) // 2]

    b = np.array([lower_median(x[:, i]) for i in range(p)])
    w = np.array([lower_median(np.abs(x[:, i] - b[i])) for i in range(p)])
    box = (np.abs(x - b) <= 4 * w + np.array([int(r * quality_rules.STEPS) for r in quality_rules.RIDGES])).all(axis=1)
    found = [(b, np.diag(2.2 * w * w) + ridge), of(x), of(x[box])]
    for _ in range(quality_rules.ROUNDS):
        new = []
        for m, c in found:
            d2 = np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)
            bins = np.minimum(np.floor(d2 * quality_rules.BIN), quality_rules.FAR)
            last = np.sort(bins)[int(np.ceil(quality_rules.HALF * len(x))) - 1]
            new.append(of(x[bins <= last]))
        found = new
    m, c = min(found, key=lambda f: np.linalg.det(f[1]))
    return np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)


def test_rules_by_force(spark):
    given = rule_texts()
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(given, "doc_id long, text string, lang string, source string")).collect()}
    counts = {g[0]: base(g[1]) for g in given}
    failed = {i for i, c in counts.items() if c[0] < 20 or 100 * c[4] > 30 * c[0]}
    sizes = Counter((g[2], g[3]) for g in given if g[0] not in failed)
    groups = {}
    for g in given:
        if g[0] not in failed:
            groups.setdefault((g[2], g[3]) if sizes[g[2], g[3]] >= quality_rules.LEAST_ROWS else g[2], []).append(g[0])
    assert any(isinstance(k, str) for k in groups) and any(isinstance(k, tuple) for k in groups)
    kept = 0
    for members in groups.values():
        x = np.array([[floor(v * 1024 + 0.5) for v in (log(c[0]), log(c[1] / c[0]), log(1 + 100 * c[2] / c[0]), log(1 + 100 * c[3] / c[0]), log(1 + 100 * c[4] / c[0]))] for c in (counts[i] for i in members)], float)
        for i, d2 in zip(members, mcd(x, None)):
            if len(members) >= quality_rules.LEAST_ROWS:
                assert abs(got[i]["distance"] - d2) < 1e-6 * (1 + d2)
            assert got[i]["kept"] == (len(members) < quality_rules.LEAST_ROWS or d2 <= quality_rules.cut_off())
            kept += got[i]["kept"]
    assert {i for i, r in got.items() if r["base_failed"]} == failed and all(not got[i]["kept"] for i in failed)
    assert all(tuple(got[i][c] for c in quality_rules.BASE) == counts[i] for i in counts)
    assert 0 < kept < len(given) - len(failed)


def test_rules_edges(spark, monkeypatch):
    given = rows()
    monkeypatch.setattr(quality_rules, "SMALL_GROUPS", -1)
    got = quality_rules.quality_rules(documents(spark, given))
    assert multiset(got, "doc_id", *quality_rules.BASE) == sorted(((g[0], *base(g[1])) for g in given), key=repr)
    assert all(r["kept"] == (not r["base_failed"]) and r["distance"] is None for r in got.collect())  # too few for estimates
    assert quality_rules.quality_rules(documents(spark, [])).count() == 0


def test_rules_long_repeats(spark):
    words = sentence(1, 4000)
    texts = [words, words + " " + words, "a " * 5000, "\n".join(["same line here"] * 3000), "x" * 100_000]
    got = quality_rules.base_counts(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    assert multiset(got, "doc_id", *quality_rules.BASE) == sorted(((i, *base(t)) for i, t in enumerate(texts)), key=repr)


def test_chi_squared():
    assert abs(quality_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality_rules.chi2_quantile(0.95, 4) - 9.4877) < 1e-3


def lloyd(ids, x, k, rounds):
    from hashlib import sha256

    order = sorted(range(len(x)), key=lambda i: (ids[i] is None, sha256(f"1:{ids[i]}".encode()).hexdigest() if ids[i] is not None else "", x[i].tolist()))
    c = [x[i].tolist() for i in order[:k]]
    for step in range(rounds + 1):
        d = [[sum((int(a) - b) ** 2 for a, b in zip(v, m)) for m in c] for v in x]
        label = [min(range(len(c)), key=lambda j: (row[j], j)) for row in d]
        if step < rounds:
            for j in range(len(c)):
                members = [x[i] for i in range(len(x)) if label[i] == j]
                if members:
                    c[j] = [int(sum(int(v[i]) for v in members)) // len(members) for i in range(len(c[j]))]
    return label, [row[j] for row, j in zip(d, label)], c


def clustered(spark, ids, x, k=4, rounds=3, slices=3):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(slices)
    return centroid_clusters(df, k=k, rounds=rounds, dims=x.shape[1], scale=1)


def test_clusters_are_those_of_plain_rounds(spark):
    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(c, 20, (150, 6)) for c in (-300, 0, 300)] + [np.full((80, 6), 7.0), g.integers(-1, 2, (60, 6))])
    ids = list(range(len(x)))
    ids[5], ids[6], ids[7] = 4, 4, None
    assigned, centroids = clustered(spark, ids, x, k=5)
    label, distance, c = lloyd(ids, np.floor(x).astype(np.int64), 5, 3)
    assert multiset(assigned, "vec_id", "cluster", "distance") == sorted(zip(ids, label, distance), key=repr)
    got = {r["cluster"]: r for r in centroids.collect()}
    assert [got[j]["center"] for j in range(5)] == c
    for j in range(5):
        own = [d for d, k in zip(distance, label) if k == j]
        assert (got[j]["n"], got[j]["cluster_inertia"], got[j]["inertia"]) == (len(own), sum(own), sum(distance))


def test_whole_balls_are_assigned_at_once():
    g = np.random.default_rng(2)
    x = np.concatenate([g.normal(c, 3, (500, 8)) for c in (-200, 0, 200)]).astype(np.int64)
    tree, order = BallTree.over(x)
    assert (tree.vectors == x[order]).all() and (tree.sums[0] == x.sum(axis=0)).all()
    assert all(np.linalg.norm(tree.vectors[a:b] - s / (b - a), axis=1).max() <= r + 1e-9 for a, b, s, r in zip(tree.first, tree.end, tree.sums, tree.radius))
    centroids = np.array([[-200] * 8, [0] * 8, [200] * 8])
    node, of, label = tree.assign(centroids)
    assert (tree.end[node] - tree.first[node]).sum() == 1500 and (label == -1).all() and sorted(set(of)) == [0, 1, 2]
    ties = np.array([[-1] * 8, [1] * 8])
    zero, _ = BallTree.over(np.zeros((100, 8), np.int64))
    assert (zero.assign(ties)[2] == 0).all()  # the same distance: the smaller number


def test_clusters_edges(spark):
    rows_ = [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-0.5, 0.25]), (7, [-0.5, 0.25])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows_], "vec_id long, embedding array<double>, v string, cluster int")
    assert multiset(integer_vectors(df, 2, 4), "vec_id", "v") == [(1, [4, 8]), (7, [-2, 1]), (7, [-2, 1])]
    assigned, centroids = centroid_clusters(df, k=16, dims=2, scale=4)
    assert multiset(assigned, "vec_id", "distance") == [(1, 0), (7, 0), (7, 0)] and centroids.count() == 3
    assigned, centroids = centroid_clusters(df.limit(0), dims=2)
    assert assigned.count() == 0 and centroids.count() == 0
    assert SCHEMA.startswith("doc_id")
