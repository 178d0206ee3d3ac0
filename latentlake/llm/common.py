"""Helpers shared by the operators: shared-folder tables, partition sizing, query registration."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentlake.runtime import scratch_path, scratch_scope, settle, ship

__all__ = ["ORACLES", "QUERIES", "WORD", "fresh", "narrow_batches", "parts_for", "query", "read", "release", "scratch_path", "scratch_scope", "settle", "ship", "typed", "word_count"]

#: A word, in Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of rows that go to a Python worker at once inside ``narrow_batches``: two slices of text.
BATCH_BYTES = 1_900_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``, with DuckDB SQL for the same rows if there is any."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return wrap


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, in their types: extra columns with clashing names go before any join."""
    return df.select(*(F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: str | Column) -> Column:
    """Number of words as long; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps: it acts when the driver's JVM collects unused plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def narrow_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """Batches end at ``limit`` bytes, not at 10,000 rows alone, in jobs that run inside: an executor holds one or two for each task in its JVM
    and as many in the task's worker, outside the heap. A limit that the session sets itself holds."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(name)


def parts_for(spark: SparkSession, total: float, each: float) -> int:
    """Partitions so that each holds about ``each`` of ``total``, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / each), 1)
