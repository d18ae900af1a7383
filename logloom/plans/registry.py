"""The registry of queries over the driver's tables, and of their SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.plans.adapter import EVT
from logloom.plans.scenes import SC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name; sql may use the tables `evt` and `sc`, which are put
    before it unless it has a WITH of its own."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            used = [t for name, t in (("evt", EVT), ("sc", SC)) if re.search(rf"\b{name}\b", sql)]
            ORACLES[f.__name__] = f"WITH {', '.join(used)}\n{sql}" if used and not sql.lstrip().upper().startswith("WITH") else sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
