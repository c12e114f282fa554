"""The stated questions of the retrieval queries: a fixed set, asked of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUESTIONS = (
    (1, "What is that which comes with this and from there"),
    (2, "Le quelle est dans pour avec les"),
    (3, "der die und nicht sich auch von den"),
    (4, "que para con los las del una"),
    (5, "montare priza si tablou, cum se face cu 30 mm minim"),
)

QUESTION_VALUES = ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id long, text string")
