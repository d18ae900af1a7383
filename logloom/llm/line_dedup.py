"""Line deduplication with levelled sorted runs of line hashes; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import dropped, fresh_path, written

_EDGE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_EDGE)), _UPPER, _LOWER)


def _keyed(docs: DataFrame, least_chars: int, batches: int) -> DataFrame:
    """A row (doc_id, text_hash, line_no, k1, k2, batch) for each line with a key of at least least_chars code points."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    keys = lines.filter(F.length("line") >= least_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= least_chars)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    return keys.select("doc_id", "text_hash", "line_no", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), batch)


@dataclass
class LineRuns:
    """Levelled runs of line keys: k1, k2, n_docs, last_doc.

    Each run is written once, bucketed and sorted by its key, so runs merge with a batch, and with each other,
    bucket by bucket without a shuffle. add() merges a batch with all runs: keys that none holds come with what
    the batch says; of the others the new run holds what all batches so far say together, and what older
    runs say of them is out of date. So a key's largest row is its last, and what a key comes to is known when its last batch is
    added. When a level holds `fanout` runs, compact() merges them to one of the next level. Every document
    belongs to one batch. State lives in the shared folder; the driver holds names.
    """

    spark: SparkSession
    fanout: int = 2
    levels: list[list[str]] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)
    merges: int = 0

    def __post_init__(self) -> None:
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _run(self, rows: DataFrame) -> str:
        """Write a run. Its rows are dealt by key already: no further exchange."""
        name = f"line_run_{uuid4().hex}"
        self.paths[name] = fresh_path(self.spark, name)
        rows.select("k1", "k2", "n_docs", "last_doc").write.option("path", self.paths[name]).bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            dropped(self.spark, self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")
            del self.paths[name]

    def _held(self, name: str, i: int) -> DataFrame:
        return self.spark.table(name).select("k1", "k2", F.col("n_docs").alias(f"n{i}"), F.col("last_doc").alias(f"d{i}")).hint("merge")

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, keys: DataFrame) -> str:
        """keys: doc_id, k1, k2 of a batch, repeated within a document or not. Returns the name of its run."""
        once = keys.select("k1", "k2", "doc_id").distinct()
        rows = once.groupBy("k1", "k2").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        names = self.runs()
        for i, run in enumerate(names):
            rows = rows.join(self._held(run, i), ["k1", "k2"], "left")
        if names:
            # The newest row of a key counts most documents.
            before = F.coalesce(F.greatest(*(f"n{i}" for i in range(len(names)))) if len(names) > 1 else F.col("n0"), F.lit(0))
            rows = rows.select("k1", "k2", (F.col("n_docs") + before).alias("n_docs"), F.greatest("last_doc", *(f"d{i}" for i in range(len(names)))).alias("last_doc"))
        name = self._run(rows)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        return name

    def compact(self) -> None:
        """Merge every level that is full, by full outer merge joins; runs that went into a merge are deleted."""
        for at in range(len(self.levels)):
            if len(self.levels[at]) >= self.fanout:
                full = self.levels[at]
                rows = self.spark.table(full[0])
                for run in full[1:]:
                    rows = rows.join(self._held(run, 0), ["k1", "k2"], "full").select("k1", "k2", F.greatest("n_docs", "n0").alias("n_docs"), F.greatest("last_doc", "d0").alias("last_doc"))
                name = self._run(rows)
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(name)
                self.levels[at] = []
                self.merges += 1
                self._drop(full)

    def heavy(self, least_docs: int) -> DataFrame:
        """k1, k2, last_doc of the keys that at least least_docs documents hold; of keys in fewer, no row is read
        beyond a filter. Rows of a key in several runs become one, so of heavy keys alone are there any to combine."""
        # Read as plain files: a union of bucketed scans claims a partitioning by key that it doesn't have (Spark 4.1).
        some = [self.spark.read.schema(self.spark.table(n).schema).parquet(self.paths[n]).filter(F.col("n_docs") >= least_docs) for n in self.runs()]
        return reduce(DataFrame.unionByName, some).groupBy("k1", "k2").agg(F.max("last_doc").alias("last_doc"))

    def drop(self) -> None:
        self._drop(self.runs())
        self.levels = []


def _lost(docs: DataFrame, least_chars: int, least_docs: int, batches: int, fanout: int) -> DataFrame:
    """d, t, lost: the sorted numbers of the lines to drop from the texts with the hash t of document d."""
    spark = docs.sparkSession
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    lines = written(_keyed(keys, least_chars, batches), "lines", "batch")
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b))
        runs.compact()
    heavy = runs.heavy(least_docs)
    lost = lines.join(heavy, ["k1", "k2"]).filter("doc_id < last_doc").select("doc_id", "k1", "k2").distinct()
    # Repeated rows of a doc_id may hold other lines, so what is lost goes by document and key.
    lost = lines.join(lost, ["doc_id", "k1", "k2"], "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.array_sort(F.collect_set("line_no")).alias("lost"))
    lost = written(lost, "lost")
    runs.drop()
    dropped(spark, lines)
    return lost


def _with_lost(rows: DataFrame, doc_id: Column, text: Column, lost: DataFrame) -> DataFrame:
    return rows.join(lost, (doc_id.cast("long") == F.col("d")) & (F.xxhash64(text) == F.col("t")), "left").drop("d", "t")


def _kept(text: Column) -> Column:
    # Between two lost lines a slice stays; slicing costs what it copies, however many lines go.
    lines = F.split(text, "\n", -1)
    gaps = F.arrays_zip(F.array_prepend("lost", F.lit(-1)).alias("a"), F.array_append("lost", F.size(lines)).alias("b"))
    return F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 2, g["b"] - g["a"] - 1))), "\n")


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 3, fanout: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: whole texts without the lines that many documents share.

    Lines are what stands between line feeds. A key (line_key) of at least least_chars code points that at
    least least_docs documents hold loses all its lines except in the largest doc_id that holds it. The
    documents go through the runs (LineRuns) in `batches`, by a hash of doc_id; then their lines meet the keys that
    the runs say are heavy.
    Keys are compared by 128 bits of hash. Null and empty texts are one empty line; rows without doc_id
    are left as they are and hold no key; rows with the same doc_id are one document when keys are counted,
    and each gives a row; other columns are not read; no rows in, no rows out.

    Counting pre-aggregates by key before its shuffle, so a line in a third of all documents is one row per
    task; the join of lines and totals has unique keys on one side, so Spark can split a skewed key. Texts
    are shuffled once, by document.
    """
    docs = docs.select("doc_id", "text")
    joined = _with_lost(docs, F.col("doc_id"), F.col("text"), _lost(docs, least_chars, least_docs, batches, fanout))
    none, text = F.col("lost").isNull(), F.coalesce("text", F.lit(""))
    return joined.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
        F.when(none, text).otherwise(_kept(text)).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 3, fanout: int = 2) -> DataFrame:
    """The rows and columns of docs, whatever their names, texts without the lines that drop_repeated_lines()
    drops, and n_chars, if there, made to fit. Texts that lose nothing stay as they are, null too."""
    lost = _lost(docs, least_chars, least_docs, batches, fanout)
    row = lambda c: F.col("row").getField(c)
    joined = _with_lost(docs.select(F.struct("*").alias("row")), row("doc_id"), row("text"), lost)
    none = F.col("lost").isNull()
    text = F.when(none, row("text")).otherwise(_kept(row("text")))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(none, row("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(changed.get(c, row(c)).alias(c) for c in docs.columns))
