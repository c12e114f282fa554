"""Writing tables: append, upsert, delete and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.sources.tables import first_row


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows with those of the same key replaced by the new ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_row(both, [key], F.desc("_new")).drop("_new")


def without(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among those that go; children follow by the same call on their parent key."""
    return old.join(gone.select(key).distinct(), key, "left_anti")


def markdown_table(df: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """One row with the first rows as a Markdown table, for reports of bounded size."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}\n"
    rows = df.orderBy(*columns).limit(most).select(F.struct(*columns, line.alias("_line")).alias("r"))
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["_line"]), "\n")).alias("markdown"))
