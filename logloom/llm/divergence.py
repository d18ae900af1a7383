"""Divergence of the sources of a language from each other and from the language, term by term, in exact integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm import textbatch as tb
from logloom.llm.shared import written

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SLICE = 2 << 20
#: Groups up to this many are broadcast to their postings (some 100 bytes each); beyond it the joins shuffle.
SMALL_GROUPS = 100_000
_COUNTS = "lang string, source string, term string, df long, n long"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all rows, A-Z in lower case, and their rows."""
    start, end, row = tb.words(data, offsets, LETTERS)
    letters = tb.folded(data[LETTERS[data]])
    edges = np.concatenate(([0], np.cumsum(end - start)))
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(letters)])
    return terms.dictionary_encode(), row


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, sorted, and the sums of the values of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(v[order], first) if len(key) else v for v in values)


def _slice_counts(group: np.ndarray, data: np.ndarray, offsets: np.ndarray, seen: set[bytes] | None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """group, term, df, n of a slice; seen: the terms of the earlier parts of the same text, kept up to date."""
    coded, row = _terms(data, offsets)
    names, width = coded.dictionary, max(1, len(coded.dictionary))
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    by_row, n = _summed(row * width + index, np.ones(len(row), np.int64))
    df = np.ones(len(n), np.int64)
    if seen is not None:
        held = names.take(pa.array(by_row % width)).to_pylist()
        df = np.array([t not in seen for t in held], np.int64)
        seen.update(held)
    key, df, n = _summed(group[by_row // width] * width + by_row % width, df, n)
    return key // width, names.take(pa.array(key % width)), df, n


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in tb.slices(batches, most=_SLICE):
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        many = max(1, len(source.dictionary))
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * many + source.indices.to_numpy(zero_copy_only=False)
        parts, seen = [(0, len(data))], None
        if batch.num_rows == 1 and len(data) > _SLICE:
            parts, seen = tb.long_parts(data, LETTERS, _SLICE, 0), set()
        for a, b in parts:
            at, term, df, n = _slice_counts(group, data[a:b], offsets if seen is None else np.array([0, b - a]), seen)
            columns = [lang.dictionary.take(pa.array(at // many)), source.dictionary.take(pa.array(at % many)), pc.cast(term, pa.string()), pa.array(df), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "df", "n"])


def _share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / total), exact: in decimals where the product may leave the range of long."""
    unit = F.lit(1_000_000_000).cast("long")
    wide = F.call_function("div", unit.cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), total.cast("decimal(19,0)"))
    return F.when(n < 9_000_000_000, F.call_function("div", unit * (n + 1), total)).otherwise(wide) + 1


def _price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _postings(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n, lang_n, first: the kept terms of each group; first marks one posting of each term of a language."""
    counts = docs.mapInArrow(_term_counts, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    term = W.partitionBy("lang", "term")  # a row for each source, however frequent the term
    counts = counts.select("*", F.sum("df").over(term).alias("lang_df"), F.sum("n").over(term).alias("lang_n"), (F.col("source") == F.min("source").over(term)).alias("first"))
    return counts.filter(F.col("lang_df") >= least_docs).drop("df", "lang_df")


def _groups(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, total, lang_total, support, v, p0 of every group: N + V of the group and of its language, the
    number of its kept terms and of its language's, and the p of a term that the group lacks (null if V is 0)."""
    held = postings.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("term").alias("support"), F.count_if("first").alias("firsts"))
    langs = held.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("firsts").alias("v"))
    groups = docs.select("lang", "source").distinct().join(held.drop("firsts"), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    groups = groups.select("lang", "source", (F.col("n") + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"), "support", "v")
    return groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"))))


def _pairs(priced: DataFrame, groups: DataFrame, small: DataFrame) -> DataFrame:
    """lang, source, item, value: every two sources of a language, by inclusion and exclusion over their terms.

    The terms that neither has cost a constant each. Those of one side alone are priced as if the other had none
    of them, from the histogram of the side's p. Where both have a term, the join of postings puts the two
    one-sided prices and the constant right.
    """
    histogram = written(priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")), "histogram")
    other = small.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("support").alias("item_support"))
    p, p0, q0, m = (F.col(c) for c in ("p", "p0", "q0", "m"))
    neither = groups.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.coalesce((F.col("v") - F.col("support") - F.col("item_support")) * _price(p0, q0), F.lit(0).cast("long")).alias("value"))
    sided = histogram.join(other, "lang").filter("source <> item")
    mine = sided.groupBy("lang", "source", "item").agg(F.sum(m * _price(p, q0)).alias("value"))
    theirs = sided.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(F.sum(m * _price(q0, p)).alias("value"))
    a = priced.select("lang", "term", "source", "p", "p0")
    b = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    q = F.col("q")
    there, back = (_price(x, y) - _price(x, y0) - _price(x0, y) + _price(x0, y0) for x, x0, y, y0 in ((p, p0, q, q0), (q, q0, p, p0)))
    both = a.join(b, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(there).alias("there"), F.sum(back).alias("back"))
    ways = (F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    both = both.select("lang", F.inline(F.array(*ways)))
    parts = neither.unionByName(mine).unionByName(theirs).unionByName(both)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence_audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: what sets each source of a language apart.

    Terms are runs of letters (A-Z, in lower case, a-z and everything beyond ASCII) of whole texts. A language
    keeps the V terms that at least least_docs of its rows hold. A group (lang, source), and each language,
    gives a kept term of `count` occurrences p = 1 + floor(10^9 (count + 1) / (N + V)), N all its occurrences
    of kept terms. value is floor((p - q)^2 / q): in part `pair` summed over all kept terms, item another
    source of the language with its q, all ranks; in part `term` for each term that the group has and has
    more of than its language (q), the first most_terms by value. Ties go by item. All in integers.

    Null text, lang and source read as ''. Every row is a document of its own, rows that repeat too. A group
    without terms has its pairs; a language without kept terms has pairs of value 0. Other columns are not
    read; no rows in, no rows out. An ArithmeticException tells of sums beyond long.

    Occurrences are counted in tasks and combined before each shuffle, so neither a hot source nor a frequent
    term is many rows of one task. The join of postings gives a row for each two sources that share a term, and
    the result has a row for each two sources of a language: work that the number of sources drives, not that of documents.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    postings = written(_postings(docs, least_docs), "postings")
    groups = written(_groups(docs, postings), "groups")
    small = F.broadcast(groups) if groups.count() <= SMALL_GROUPS else groups
    priced = postings.join(small, ["lang", "source"]).select("lang", "source", "term", _share(F.col("n"), F.col("total")).alias("p"), _share(F.col("lang_n"), F.col("lang_total")).alias("q"), "p0")
    priced = written(priced, "priced")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(priced, groups, small).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    terms = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _price(F.col("p"), F.col("q")).alias("value"))
    terms = terms.select("*", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= most_terms)
    return pairs.unionByName(terms)
