"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import langid, quality
from logloom.llm import quality_rules as rules
from logloom.llm.ann import search
from logloom.llm.balltree import centroid_clusters
from logloom.llm.bpe import encode_decode
from logloom.llm.decontam import benchmark_of, find_leaks
from logloom.llm.divergence import divergence_audit
from logloom.llm.fm_dedup import drop_repeated_word_spans
from logloom.llm.line_dedup import drop_repeated_lines
from logloom.llm.minhash import near_duplicates
from logloom.llm.suffix_dedup import drop_repeated_substrings
from logloom.llm.token_count import count_tokens


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=3, percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(documents(spark, sf_dir), benchmark_of(spark, sf_dir))
    return leaks.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_substrings(documents(spark, sf_dir), window=200)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, quality.ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), grades=3)
    return quality.grade(docs, model, tail_from=2)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: digests of bpe.encode_decode(). Null and empty texts
    have no tokens and the digests of the empty text; no rows in, no rows out."""
    coded = encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))


def op10_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_word_spans(documents(spark, sf_dir), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(documents(spark, sf_dir))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir)).drop("distance")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    centre = F.sha2(F.array_join(F.col("center").cast("array<string>"), ","), 256)
    return assigned.join(F.broadcast(centroids.select("cluster", "cluster_inertia", "inertia", centre.alias("centroid_sha256"))), "cluster")


QUERIES = {
    "op1_permutation_index": op1_permutation_index,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_fm_dedup": op10_fm_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_quality_rules": op12_quality_rules,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLES: dict[str, str] = {}

ORACLES["op2_near_duplicates"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.x = d.doc_id
"""

ORACLES["op3_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
p AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.r = d.r LEFT JOIN t ON t.r = d.r
"""

ORACLES["op4_line_dedup"] = r"""
WITH l AS (SELECT r, doc_id, line_no, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS line_no FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
h AS (SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.r, l.doc_id, l.line_no, l.line, h.k IS NOT NULL AND l.doc_id < h.last_doc AS lost FROM l LEFT JOIN h ON h.k = l.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY r
"""

ORACLES["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_n FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY o.lang, o.source, o.term),
g AS (SELECT x.lang, x.source, coalesce(t.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) t ON t.lang = x.lang AND t.source = x.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + l.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (l.lang_n + l.v)::HUGEINT AS q
  FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""


def _kmeans_sql(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds over (vector, component) rows, all distances computed."""
    out = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
x AS (SELECT r, unnest(v) AS a, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < """ + str(k) + """),
m0 AS (SELECT c, unnest(v) AS b, generate_subscripts(v, 1) AS i FROM s)"""
    for t in range(rounds + 1):
        out += f""",
a{t} AS (SELECT r, c, d FROM (SELECT x.r, m.c, sum((x.a - m.b) * (x.a - m.b)) AS d FROM x JOIN m{t} m ON m.i = x.i GROUP BY x.r, m.c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),
t{t} AS (SELECT a.c, x.i, sum(x.a) AS s, count(*) AS n FROM a{t} a JOIN x ON x.r = a.r GROUP BY a.c, x.i),
m{t + 1} AS (SELECT m.c, m.i, coalesce((t.s - ((t.s % t.n) + t.n) % t.n) // t.n, m.b) AS b FROM m{t} m LEFT JOIN t{t} t ON t.c = m.c AND t.i = m.i)"""
    return out + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN v ON v.r = a.r JOIN (SELECT c, sha256(string_agg(CAST(b AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c) h ON h.c = a.c
"""


ORACLES["op13_centroid_clusters"] = _kmeans_sql()


def _rules_sql() -> str:
    """The counts by unnesting words and lines; the estimates as unrolled steps with the operator's formulas, so that no rounding differs."""
    steps = lambda x: "".join(f", {s}" for s in x)
    own = [f"{name}" for name in ("m1", "m2", "m3", "m4", "m5")] + [f"l{i}{j}" for i in range(1, 6) for j in range(1, i + 1)]
    estimates = lambda of: f"SELECT grp, start, {', '.join(own)}, {rules.size_of_ellipsoid()} FROM (SELECT *{steps(rules.centre())}{steps(rules.covariance())}{steps(sum(rules.triangle(), []))} FROM {of})"
    long = lambda c: f"CAST({c} AS BIGINT)"
    out = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT s) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY r),
b0 AS (SELECT d.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dup ON dup.r = d.r LEFT JOIN rep ON rep.r = d.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b0),
sz AS (SELECT lang, source, count(*) FILTER (NOT base_failed) AS n FROM b GROUP BY lang, source),
lz AS (SELECT lang, sum(n) AS n FROM sz WHERE n < 50 GROUP BY lang),
rz AS (SELECT coalesce(sum(n), 0) AS n FROM lz WHERE n < 50),
nm AS (SELECT sz.lang, sz.source, CASE WHEN sz.n >= 50 THEN '2:' || length(sz.lang) || ':' || sz.lang || sz.source WHEN lz.n >= 50 THEN '1:' || sz.lang WHEN rz.n >= 50 THEN '0:' END AS grp FROM sz CROSS JOIN rz LEFT JOIN lz ON lz.lang = sz.lang),
f AS (SELECT b.*, nm.grp FROM b JOIN nm ON nm.lang = b.lang AND nm.source = b.source WHERE NOT base_failed AND nm.grp IS NOT NULL),
x AS (SELECT r, grp""" + "".join(f", CAST(floor({e} * {rules.STEPS} + 0.5) AS BIGINT) AS x{i}" for i, e in enumerate(rules.STATISTICS, 1)) + """ FROM f),
h AS (SELECT grp, unnest([1, 2, 3, 4, 5]) AS k, unnest([x1, x2, x3, x4, x5]) AS x FROM x),
hb AS (SELECT grp, k, min(x) AS b FROM (SELECT *, count(*) OVER (PARTITION BY grp, k ORDER BY x) AS upto, count(*) OVER (PARTITION BY grp, k) AS al FROM h) WHERE 2 * upto >= al GROUP BY grp, k),
hw AS (SELECT grp, k, min(x) AS w FROM (SELECT *, count(*) OVER (PARTITION BY grp, k ORDER BY x) AS upto, count(*) OVER (PARTITION BY grp, k) AS al FROM (SELECT h.grp, h.k, abs(h.x - hb.b) AS x FROM h JOIN hb ON hb.grp = h.grp AND hb.k = h.k)) WHERE 2 * upto >= al GROUP BY grp, k),
md AS (SELECT hb.grp""" + "".join(f", max(b) FILTER (hb.k = {i}) AS b{i}, max(w) FILTER (hb.k = {i}) AS w{i}" for i in range(1, 6)) + f""" FROM hb JOIN hw ON hw.grp = hb.grp AND hw.k = hb.k GROUP BY hb.grp),
ss AS (SELECT x.grp, start, {", ".join(rules.moments())} FROM x JOIN md ON md.grp = x.grp JOIN (VALUES (1), (2)) v(start) ON start = 1 OR {rules.in_box()} GROUP BY x.grp, start),
e0 AS (SELECT *, {rules.size_of_ellipsoid()} FROM (SELECT grp, 0 AS start{steps(rules.diagonal())} FROM md) UNION ALL {estimates("ss")})"""
    sums = ["n", *(f"s{i}" for i in range(1, 6)), *(f"p{i}{j}" for i in range(1, 6) for j in range(1, i + 1))]
    for t in range(rules.ROUNDS):
        out += f""",
s{t} AS (SELECT grp, start, bin, {", ".join(rules.moments())} FROM (SELECT *{steps(rules.distance())}, {rules.bin_of()} FROM x JOIN e{t} USING (grp)) GROUP BY grp, start, bin),
n{t} AS (SELECT grp, start, {", ".join(f"{long(f'sum({c})')} AS {c}" for c in sums)} FROM (SELECT *, sum(n) OVER (PARTITION BY grp, start ORDER BY bin) - n AS before, sum(n) OVER (PARTITION BY grp, start) AS al FROM s{t}) WHERE before < {rules.HALF} * al GROUP BY grp, start),
e{t + 1} AS ({estimates(f"n{t}")})"""
    return out + f""",
best AS (SELECT * FROM e{rules.ROUNDS} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY det, start) = 1),
z AS (SELECT r, d2 FROM (SELECT *{steps(rules.distance())} FROM x JOIN best USING (grp)))
SELECT b.doc_id, {", ".join(f"{long(f'b.{c}')} AS {c}" for c in rules.BASE)}, base_failed, NOT base_failed AND (z.d2 IS NULL OR z.d2 <= {rules.cut_off()!r}) AS kept FROM b LEFT JOIN z ON z.r = b.r
"""


ORACLES["op12_quality_rules"] = _rules_sql()
