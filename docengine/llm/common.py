"""Shared helpers: table loading, shared scratch tables, small-table checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (single-machine tests).
LOCAL_FALLBACK = "/tmp/checkpoints"

#: Spark's switch to delete the shuffle files of a finished execution at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folder names of one scratch table.
_PREFIX = "docengine"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share."""
    return spark.conf.get("spark.checkpoint.dir", None) or LOCAL_FALLBACK


def release(spark: SparkSession) -> None:
    """Let the driver's collector find what finished jobs left behind.

    The context cleaner deletes shuffle files and broadcasts of finished jobs
    only once the driver has collected their garbage, which an idle driver may
    not do for half an hour.
    """
    spark._jvm.System.gc()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions inside delete their own shuffle files when they end."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A lost executor re-reads a finished scratch table instead of recomputing
    the stages before it.  ``drop`` removes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{_PREFIX}-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:02d}-{name}"
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        release(self.spark)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path is None:
                continue
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of a small table, or None if it has more than ``limit`` rows.

    Reads at most ``limit + 1`` rows to the driver, so the size is proven.
    """
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def most_frequent(counts: DataFrame, token: str, n: str, limit: int):
    """The most frequent tokens as a pandas table, most frequent first: at most ``limit`` rows.

    Where the limit falls is found from a histogram of the counts' logarithms, a
    few hundred rows, so that no task sends more than its part of the result.
    Tokens of the level at which the limit would be passed are left out.
    """
    rows = frequent_rows(counts, n, limit).select(token, n).toPandas()
    return rows.sort_values([n, token], ascending=[False, True], ignore_index=True)


def frequent_rows(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """The rows of the largest counts, at most ``limit``; those of the level at which it would be passed are left out."""
    level = F.floor(F.log2(F.col(n)) * 8)
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("tokens")).collect()
    cut, total = None, 0
    for row in sorted(levels, key=lambda r: -r["level"]):
        total += row["tokens"]
        if total > limit:
            break
        cut = row["level"]
    return counts.where(level >= cut if cut is not None else F.lit(False))
