"""A corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Language identification, line deduplication, near-duplicate removal, benchmark decontamination, BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm.decontam import benchmark_of, decontaminate
from logloom.llm.langid import in_known_language
from logloom.llm.line_dedup import without_repeated_lines
from logloom.llm.minhash import keep_one
from logloom.llm.queries import bpe_digests
from logloom.llm.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter and a likely language go on (operator 5)."""
    return in_known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share stay in the last of them only (operator 4)."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 (operator 2)."""
    return keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go (operator 3)."""
    return decontaminate(docs, benchmark_of(spark, sf_dir), words=10, action="documents")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded and decoded again (operator 9)."""
    return bpe_digests(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: A classifier that is trained on the way can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
