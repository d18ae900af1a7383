"""Quality rules: counts of whole texts, and robust multivariate outliers by language and source; DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from math import erf, exp, gamma, pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.shared import written

_SPACE = r"[\x20\x09-\x0D]"
_WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The statistics, natural logarithms; they count in steps of 1 / STEPS, so that sums of their products are exact.
STATISTICS = (
    "ln(n_words)",
    "ln(word_chars / n_words)",
    "ln(1 + 100 * n_symbols / n_words)",
    "ln(1 + 100 * n_dup_lines / n_words)",
    "ln(1 + 100 * n_repeat_words / n_words)",
)
STEPS, P = 1024, len(STATISTICS)
#: Deviations, in units of the logarithms, whose squares are added to the variances: where most texts have no symbol
#: at all, a few are no outlier. Wider for repetitions, which texts that pass the base rule may hold up to 30 % of.
RIDGES = (0.25, 0.25, 0.25, 0.5, 0.5)
#: Share of the rows that the estimates rest on, and rows that a group needs for its own.
HALF, LEAST_ROWS = 0.75, 50
#: Squared distances count in steps of 1 / 64, those of 1024 and more as one.
BIN, FAR = 64, 1 << 16
STARTS, ROUNDS = 3, 4
#: Share of the rows of a normal distribution that lie beyond the cut.
TAIL = 1e-9
#: Groups up to this many are broadcast to the rows (some 300 bytes each); beyond it the joins shuffle.
SMALL_GROUPS = 100_000

_PAIRS = [(i, j) for i in range(1, P + 1) for j in range(1, i + 1)]
_SUMS = ["n", *(f"s{i}" for i in range(1, P + 1)), *(f"p{i}{j}" for i, j in _PAIRS)]


def chi2_below(x: float, p: int) -> float:
    """The share of a chi-squared distribution of p degrees below x."""
    at = 2 - p % 2
    below = 1 - exp(-x / 2) if at == 2 else erf(sqrt(x / 2))
    while at < p:
        below -= (x / 2) ** (at / 2) * exp(-x / 2) / gamma(at / 2 + 1)
        at += 2
    return below


def chi2_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, p) < share else (low, middle)
    return high


def cut_off(tail: float = TAIL) -> float:
    """The largest squared distance of a kept row. What a share HALF of a normal sample spans is too narrow by the second factor."""
    return chi2_quantile(1 - tail, P) * HALF / chi2_below(chi2_quantile(HALF, P), P + 2)


def moments(weight: str = "1") -> list[str]:
    """SQL of the sums that means and covariances need; weight 0 leaves a row out."""
    each = [weight, *(f"{weight} * x{i}" for i in range(1, P + 1)), *(f"{weight} * x{i} * x{j}" for i, j in _PAIRS)]
    return [f"CAST(sum({x}) AS BIGINT) AS {name}" for x, name in zip(each, _SUMS, strict=True)]


def _ridge(i: int) -> str:
    return repr((RIDGES[i - 1] * STEPS) ** 2)


def centre() -> list[str]:
    return [f"CAST(s{i} AS DOUBLE) / n AS m{i}" for i in range(1, P + 1)]


def covariance() -> list[str]:
    return [f"CAST(p{i}{j} AS DOUBLE) / n - m{i} * m{j} + CAST({_ridge(i) if i == j else '0.0'} AS DOUBLE) AS c{i}{j}" for i, j in _PAIRS]


def triangle() -> list[list[str]]:
    """SQL of the Cholesky factor of c, column by column: each list needs those before."""
    out = []
    for j in range(1, P + 1):
        less = lambda i: "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))  # noqa: B023, E731
        out.append([f"sqrt(c{j}{j}{less(j)}) AS l{j}{j}"])
        if j < P:
            out.append([f"(c{i}{j}{less(i)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, P + 1)])
    return out


def size_of_ellipsoid() -> str:
    return " * ".join(f"l{i}{i}" for i in range(1, P + 1)) + " AS det"


def distance() -> list[str]:
    """SQL of z1, z2, ... and the squared distance d2 of x1, x2, ... from m under the factor l; each needs those before."""
    z = [f"(x{i} - m{i}{''.join(f' - l{i}{k} * z{k}' for k in range(1, i))}) / l{i}{i} AS z{i}" for i in range(1, P + 1)]
    return [*z, " + ".join(f"z{i} * z{i}" for i in range(1, P + 1)) + " AS d2"]


def bin_of() -> str:
    return f"CAST(least(floor(d2 * {BIN}), {FAR}) AS BIGINT) AS bin"


def _with(df: DataFrame, *steps: str) -> DataFrame:
    """df with one further column for each `expression AS name`."""
    return reduce(lambda d, s: d.selectExpr("*", s), steps, df)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text.

    Windows of eight words are compared by hashes first; texts with equal ones compare those windows themselves.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text.alias("text"))
    worded = named.withColumn("words", F.filter(F.split("text", f"{_SPACE}+", -1), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = worded.select("doc_id", "lang", "source", "words", F.size("words").alias("n"), F.length(F.array_join("words", "")).alias("word_chars"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"), lines.alias("lines"))
    hashes = F.when(F.col("n") > _WINDOW, F.transform(F.sequence(F.lit(1), F.col("n") - _WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, _WINDOW))))
    counted = counted.withColumn("h", hashes)
    # All or nothing: without equal hashes there is nothing to sort.
    sorted_hashes = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    counted = counted.withColumn("h", sorted_hashes)
    same = "transform({0}, (e, k) -> if((k > 0 and get({0}, k - 1).x = e.x) or get({0}, k + 1).x = e.x, e.i, null))"
    counted = counted.withColumn("h", F.array_compact(F.expr(same.format("h"))))
    counted = counted.withColumn("h", F.sort_array(F.transform("h", lambda i: F.struct(F.array_join(F.slice("words", i + 1, _WINDOW), " ").alias("x"), i.alias("i")))))
    counted = counted.withColumn("h", F.sort_array(F.array_compact(F.expr(same.format("h")))))
    gaps = F.expr(f"aggregate(transform(h, (i, k) -> least(coalesce(get(h, k + 1) - i, {_WINDOW}), {_WINDOW})), 0L, (a, b) -> a + b)")
    dup_lines = F.size("lines") - F.size(F.array_distinct("lines"))
    counts = {"n_words": F.col("n"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"), "n_dup_lines": dup_lines, "n_repeat_words": F.coalesce(gaps, F.lit(0))}
    return counted.select("doc_id", "lang", "source", *(c.cast("long").alias(name) for name, c in counts.items()))


def _grouped(stats: DataFrame) -> DataFrame:
    """stats with grp: the (lang, source) if it has LEAST_ROWS fit rows, else what its language's small sources have
    together, else what all small ones have; null if that isn't enough either."""
    size = stats.groupBy("lang", "source").agg(F.count_if("fit").alias("n")).withColumn("small", F.col("n") < LEAST_ROWS)
    langs = size.filter("small").groupBy("lang").agg(F.sum("n").alias("lang_n"))
    rest = langs.filter(F.col("lang_n") < LEAST_ROWS).agg(F.coalesce(F.sum("lang_n"), F.lit(0)).alias("rest_n"))
    own, lang = F.concat(F.lit("2:"), F.length("lang"), F.lit(":"), "lang", "source"), F.concat(F.lit("1:"), "lang")
    pooled = F.when(F.col("lang_n") >= LEAST_ROWS, lang).when(F.col("rest_n") >= LEAST_ROWS, F.lit("0:"))
    names = size.join(langs, "lang", "left").crossJoin(F.broadcast(rest)).select("lang", "source", F.when(~F.col("small"), own).otherwise(pooled).alias("grp"))  # rest is one row
    names = written(names, "group-names")
    return stats.join(_small(names), ["lang", "source"])


def _small(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.count() <= SMALL_GROUPS * STARTS else groups


def _estimates(sums: DataFrame) -> DataFrame:
    """grp, start, m, l, det from the sums of moments."""
    out = sums.selectExpr("*", *centre()).selectExpr("*", *covariance())
    for step in triangle():
        out = out.selectExpr("*", *step)
    return out.selectExpr("grp", "start", *(f"m{i}" for i in range(1, P + 1)), *(f"l{i}{j}" for i, j in _PAIRS), size_of_ellipsoid())


def _middles(rows: DataFrame) -> DataFrame:
    """grp and, for each statistic, its median b and the median absolute deviation w; both are exact, from histograms."""
    each = rows.select("grp", F.posexplode(F.array(*(f"x{i}" for i in range(1, P + 1)))).alias("k", "x"))
    histogram = written(each.groupBy("grp", "k", "x").agg(F.count(F.lit(1)).alias("n")), "histogram")

    def median(h: DataFrame, name: str) -> DataFrame:
        upto = h.withColumn("upto", F.sum("n").over(W.partitionBy("grp", "k").orderBy("x"))).withColumn("all", F.sum("n").over(W.partitionBy("grp", "k")))
        return upto.filter("2 * upto >= all").groupBy("grp", "k").agg(F.min("x").alias(name))

    b = median(histogram, "b")
    w = median(histogram.join(b, ["grp", "k"]).groupBy("grp", "k", F.abs(F.col("x") - F.col("b")).alias("x")).agg(F.sum("n").alias("n")), "w")
    one = b.join(w, ["grp", "k"])
    return one.groupBy("grp").agg(*(F.max(F.when(F.col("k") == i - 1, F.col(c))).alias(f"{c}{i}") for i in range(1, P + 1) for c in ("b", "w")))


def diagonal() -> list[str]:
    """SQL of m and l by medians and absolute deviations (1.4826 of them are a deviation)."""
    l = [f"sqrt(CAST(2.2 AS DOUBLE) * w{i} * w{i} + CAST({_ridge(i)} AS DOUBLE))" if i == j else "CAST(0 AS DOUBLE)" for i, j in _PAIRS]  # noqa: E741
    return [*(f"CAST(b{i} AS DOUBLE) AS m{i}" for i in range(1, P + 1)), *(f"{x} AS l{i}{j}" for x, (i, j) in zip(l, _PAIRS, strict=True))]


def in_box() -> str:
    """SQL: whether every statistic lies within four absolute deviations (and the ridge) of its median."""
    return " AND ".join(f"abs(x{i} - b{i}) <= 4 * w{i} + {int(RIDGES[i - 1] * STEPS)}" for i in range(1, P + 1))


def _starts(rows: DataFrame) -> DataFrame:
    """grp, start, m, l, det: medians with deviations on the diagonal (0), all rows (1), the rows near all medians (2)."""
    middles = written(_middles(rows), "middles")
    first = middles.selectExpr("grp", "0 AS start", *diagonal()).selectExpr("*", size_of_ellipsoid())
    boxed = rows.join(_small(middles), "grp").selectExpr("grp", *(f"x{i}" for i in range(1, P + 1)), f"explode(IF({in_box()}, array(1, 2), array(1))) AS start")
    return first.unionByName(_estimates(boxed.groupBy("grp", "start").agg(*map(F.expr, moments()))))


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimates after one concentration step: means and covariances of the share HALF of the rows that is
    nearest by the estimates given, to whole steps of distance. One shuffle of sums by step of distance."""
    binned = _with(rows.join(_small(estimates), "grp"), *distance(), bin_of())
    sums = binned.groupBy("grp", "start", "bin").agg(*map(F.expr, moments()))
    upto = W.partitionBy("grp", "start").orderBy("bin")
    sums = sums.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("all", F.sum("n").over(W.partitionBy("grp", "start")))
    near = sums.filter(f"before < {HALF} * all").groupBy("grp", "start").agg(*(F.sum(c).alias(c) for c in _SUMS))
    return _estimates(near)


def robust_estimates(rows: DataFrame) -> DataFrame:
    """grp, m, l, det of rows (grp, x1, x2, ...): means and triangular factors of the covariances with the least determinant found.

    From three starts, ROUNDS concentration steps each; none makes the determinant larger but for whole
    steps of distance. The start with the smallest counts, ties go to the first.
    """
    found = written(_starts(rows), "estimates")
    for _ in range(ROUNDS):
        found = written(_concentrated(rows, found), "estimates")
    best = W.partitionBy("grp").orderBy("det", "start")
    return found.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r", "start")


def statistics(stats: DataFrame) -> DataFrame:
    """x1, x2, ...: the statistics in whole steps."""
    return stats.selectExpr("*", *(f"CAST(floor({x} * {STEPS} + 0.5) AS BIGINT) AS x{i}" for i, x in enumerate(STATISTICS, 1)))


def quality_rules(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept of every row.

    Words stand between ASCII white space; word_chars counts their code points, n_symbols the characters
    #*$%&|<>, n_dup_lines the lines with a word that equal an earlier one, n_repeat_words the words in windows of
    eight that the text holds twice or more. base_failed: fewer than 20 words, or more than 30 % in such windows.
    Of the other rows, STATISTICS are held against robust estimates of their language and source
    (minimum covariance determinant, with a ridge); distance is the squared Mahalanobis distance, and kept
    those up to cut_off(tail). Groups with fewer than LEAST_ROWS such rows share estimates with others
    (_grouped); if all of them together have fewer, distance is null and they are kept. base_failed is never kept.

    Null text has no words; null lang and source read as ''. Rows stand for themselves, repeated or without
    doc_id. Other columns are not read; no rows in, no rows out.

    Texts are read once, without a shuffle. Estimates come from sums by group, start and step of distance, combined in
    tasks first: a hot source is no more work for one task than another. Sums fit a long up to some 10^10 rows a group.
    """
    stats = base_counts(docs).selectExpr("*", "n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed")
    stats = written(stats, "base-counts")
    fit = _grouped(stats.withColumn("fit", ~F.col("base_failed")))
    held = fit.filter("fit and grp is not null")
    rows = written(statistics(held).select("grp", *(f"x{i}" for i in range(1, P + 1))), "statistics")
    estimates = written(robust_estimates(rows), "estimates")
    failed, passed = fit.filter("not fit or grp is null"), _with(statistics(held).join(_small(estimates), "grp"), *distance())
    columns = ["doc_id", *BASE, "base_failed"]
    failed = failed.select(*columns, F.lit(None).cast("double").alias("distance"), (~F.col("base_failed")).alias("kept"))
    return failed.unionByName(passed.select(*columns, F.col("d2").alias("distance"), (F.col("d2") <= cut_off(tail)).alias("kept")))
