"""The driver tables, and the paragraph table that is derived from the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters on a page.
PAGE_CHARS = 3000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_numbers(parts: Column, per_page: int = PAGE_CHARS) -> Column:
    """Page of each part: the running length starts anew whenever it passes a page.

    The reset makes it a fold and not a running sum.
    """
    zero = F.struct(F.lit(1).alias("page"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("pages"))

    def step(acc, part):
        chars = acc["chars"] + F.char_length(part)
        over = chars > per_page
        page = acc["page"] + over.cast("int")
        return F.struct(page.alias("page"), F.when(over, 0).otherwise(chars).alias("chars"), F.concat(acc["pages"], F.array(page)).alias("pages"))

    return F.aggregate(parts, zero, step, lambda acc: acc["pages"])


def split_paragraphs(text: Column, delimiter: str = "\n", longer_than: int = 20) -> Column:
    """Trimmed parts of a text that are long enough."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), delimiter), lambda p: F.trim(p))
    return F.filter(parts, lambda p: F.char_length(p) > longer_than)


def paragraphs(docs: DataFrame, delimiter: str = "\n", longer_than: int = 20, pages: bool = False) -> DataFrame:
    """``doc_id, paragraph_number, content`` and, if asked for, ``page_number``."""
    parts = docs.select("doc_id", split_paragraphs(F.col("text"), delimiter, longer_than).alias("parts"))
    if pages:
        parts = parts.withColumn("parts", F.arrays_zip("parts", page_numbers(F.col("parts")).alias("pages")))
        rows = parts.select("doc_id", F.posexplode("parts").alias("n", "p"))
        return rows.select("doc_id", (F.col("n") + 1).cast("long").alias("paragraph_number"), F.col("p.parts").alias("content"), F.col("p.pages").cast("long").alias("page_number"))
    rows = parts.select("doc_id", F.posexplode("parts").alias("n", "content"))
    return rows.select("doc_id", (F.col("n") + 1).cast("long").alias("paragraph_number"), "content")


def first_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: The paragraphs in SQL, as a common table expression ``p``.
PARAGRAPHS_SQL = r"""pp as (
    select doc_id, list_filter(list_transform(string_split(coalesce("text", ''), chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 20) as parts
    from documents
), p as (
    select doc_id, cast(unnest(range(1, len(parts) + 1)) as bigint) as paragraph_number, unnest(parts) as content from pp
)"""
