"""A corpus pipeline over the documents table.

Five stages, each of which calls one operator and works on all that the stage
before it kept: quality, exact copies, near copies, benchmark leaks and the mix
of sources.  All but the last return the columns of ``documents``; the last
returns the mixed documents with the words that the mix takes from each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import Scratch
from docengine.llm.decontaminate import find_leaks
from docengine.llm.exact_dedup import content_sort_dedup
from docengine.llm.mixing import cycle_weights, mix
from docengine.llm.ngram_join import ngram_jaccard_join
from docengine.llm.quality import keep_good

#: Weights of the ordered sources, repeating.
WEIGHTS = (5, 2, 1)


#: Column by which the stages tell rows apart; never in their results.
_ROW = "_pipeline_row"


def _with_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with an id for each row: the document's own where ids are unique, else its place in their order.

    Rows without an id are last.  Places are written to the shared folder before
    they are used, so they stay the same if an executor is lost.
    """
    repeated = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() > 0
    if not repeated:
        return docs.withColumn(_ROW, F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    placed = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_ROW, F.monotonically_increasing_id())
    return Scratch(spark, "rows").save(placed, "rows")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; each row is judged by itself, whatever its id.

    Null texts are empty ones; an empty table stays empty; other columns are kept.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose texts are equal but for white space: the longest text, then the smallest id.

    Repeated rows and rows without an id are members like all others; all empty
    and null texts are one group.  An empty table stays empty; other columns are
    kept.
    """
    rows = _with_rows(spark, docs)
    kept = content_sort_dedup(rows, id_col=_ROW).where("kept").select(F.col("doc_id").alias(_ROW))
    return rows.join(kept, _ROW, "left_semi").drop(_ROW)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each component of similar documents.

    Repeated rows and rows without an id (the last ones) are members like all
    others; empty and null texts are like nothing and stay.  An empty table stays
    empty; other columns are kept.
    """
    rows = _with_rows(spark, docs)
    gone = ngram_jaccard_join(rows, id_col=_ROW).where("component_id <> doc_id").select(F.col("doc_id").alias(_ROW))
    return rows.join(gone, _ROW, "left_anti").drop(_ROW)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item, verbatim or with other values; each is judged by itself, whatever its id.

    Null and empty texts stay; an empty table stays empty; other columns are
    kept.
    """
    rows = _with_rows(spark, docs)
    leaks = find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=_ROW).select(F.col("doc_id").alias(_ROW)).distinct()
    return rows.join(leaks, _ROW, "left_anti").drop(_ROW)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: ``doc_id, source, size, target, taken``."""
    mixed = mix(docs, cycle_weights(WEIGHTS), F.array("source")).where("taken > 0")
    return mixed.select("doc_id", F.col("pattern")[0].alias("source"), "size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: A trained and a seeded stage cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each read back from the shared folder as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
