"""Keyword and vector retrieval, fusion, boosts and ranking, over batches of queries."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import lexicon, text, vector


#: Most queries of one batch that is sent to all tasks; larger batches are asked in blocks of about this size.
QUERY_BLOCK = 2_000


def in_blocks(queries: DataFrame, ask: Callable[[DataFrame], DataFrame], block: int = QUERY_BLOCK) -> DataFrame:
    """``ask`` of every query: the batch goes to all tasks, in as many blocks as its counted size takes."""
    blocks = max(1, -(-queries.count() // block))
    parts = [queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]
    return functools.reduce(DataFrame.unionByName, [ask(F.broadcast(part)) for part in parts])


def numbered(df: DataFrame, most: int, *order: Column, name: str = "place") -> DataFrame:
    """The first ``most`` rows in order, numbered; each task sends its own first rows only."""
    page = df.orderBy(*order).limit(most)
    return page.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def rank_by(df: DataFrame, keys: list[str], *order: Column, most: int | None = None, name: str = "rank") -> DataFrame:
    """Number the rows of each key from 1 and keep the first ``most``."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return out if most is None else out.where(F.col(name) <= most)


def query_variants(queries: DataFrame, most: int = 6, synonyms: dict[str, tuple[str, ...]] = lexicon.SYNONYMS) -> DataFrame:
    """The query and, for each of its known words, the query with one of its synonyms: ``query_id, rank, variant``."""
    spark = queries.sparkSession
    rows = [(t, k, s) for t, ss in synonyms.items() for k, s in enumerate(ss)]
    dictionary = F.broadcast(spark.createDataFrame(rows, "term string, k int, syn string"))
    words = queries.select("query_id", F.lower("text").alias("low"), F.posexplode(F.split(F.lower("text"), r"\s+")).alias("at", "raw"))
    words = words.withColumn("term", F.regexp_replace("raw", "[?.,!;:]$", "")).groupBy("query_id", "low", "term").agg(F.min("at").alias("at"))
    swapped = F.regexp_replace(F.col("low"), F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.col("term"), F.lit(r"\E(?![A-Za-z0-9_])")), F.col("syn"))
    more = words.join(dictionary, "term").select("query_id", swapped.alias("variant"), (F.col("at") * 10 + F.col("k")).alias("o"))
    all_ = queries.select("query_id", F.col("text").alias("variant"), F.lit(-1).alias("o")).unionByName(more)
    first = all_.groupBy("query_id", "variant").agg(F.min("o").alias("o"))
    return rank_by(first, ["query_id"], F.col("o"), most=most).select("query_id", "rank", "variant")


def keyword_candidates(paragraphs: DataFrame, queries: DataFrame, score: float | None = None) -> DataFrame:
    """Paragraphs that hold a term of a query: ``query_id, doc_id, paragraph_number, content, hits, score``.

    ``queries`` has an array ``terms``.  A paragraph is put in lower case once
    and looked through once for each query.  Without a fixed score a candidate
    scores the share of the terms that it holds.
    """
    hits = F.size(F.filter("terms", lambda t: F.contains("low", t)))
    value = F.lit(score) if score is not None else F.col("hits") / F.size("terms")
    lowered = paragraphs.withColumn("low", F.lower("content"))
    joined = in_blocks(queries.select("query_id", "terms"), lambda q: lowered.join(q).withColumn("hits", hits.cast("long")).where("hits > 0"))
    return joined.select("query_id", "doc_id", "paragraph_number", "content", "hits", value.cast("double").alias("score"))


def vector_topk(points: DataFrame, queries: DataFrame, k: int, least: float = -1.0, metric: str = "cosine") -> DataFrame:
    """The ``k`` best points of each query: ``query_id, point_id, score, rank``.

    Queries go to all tasks, block by block; every point is scored, and each task
    keeps its own best before the shuffle.
    """
    measure = vector.cosine if metric == "cosine" else lambda a, b: -vector.euclidean(a, b)
    pairs = in_blocks(queries.select("query_id", F.col("embedding").alias("wanted")), lambda q: points.select("point_id", "embedding").join(q))
    scored = pairs.select("query_id", "point_id", F.round(measure(F.col("wanted"), F.col("embedding")), 6).alias("score")).where(F.col("score") >= least)
    return rank_by(scored, ["query_id"], F.desc("score"), F.col("point_id"), most=k)


def merge_lists(lists: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Several ranked lists per query as one: the first source of a key wins, then by score."""
    first = rank_by(lists, ["query_id", *keys], F.col("source_rank"), F.desc("score"), most=1, name="_n").drop("_n")
    return rank_by(first, ["query_id"], F.desc("score"), *[F.col(k) for k in keys], most=most)


def capped(score: Column, boost: Column, cap: float) -> Column:
    """A score with a boost of at most ``cap``, never above 1."""
    return F.least(F.lit(1.0), score + F.least(boost, F.lit(cap)))


def legal_boost(score: Column, content: Column, intent: Column, words: Column, references: Column | None = None, article: Column | None = None, kinds: dict[str, Column] | None = None) -> Column:
    """Boost by intent, keyword hits and cited articles; at most 0.3 together."""
    kinds = kinds or text.classify(content)
    boost = (
        F.when((intent == "obligation") & kinds["is_obligation"], 0.2).otherwise(0.0)
        + F.when((intent == "prohibition") & kinds["is_prohibition"], 0.2).otherwise(0.0)
        + F.when((intent == "definition") & kinds["is_definition"], 0.25).otherwise(0.0)
        + text.count_matching(content, words) * 0.03
    )
    if references is not None and article is not None:
        boost = boost + F.when(F.array_contains(references, article), 0.3).otherwise(0.0)
    return capped(score, boost, 0.3)


def hybrid_boost(score: Column, query: Column, content: Column, words: Column) -> Column:
    """Boost by keywords and by domain terms in query and content; at most 0.5 together."""
    q, c = F.lower(query), F.lower(content)
    has = lambda t, terms: text.contains_any(t, terms)
    boost = (
        text.count_matching(content, words) * 0.1
        + F.when(has(q, ("protectie",)) & has(c, ("protectie",)), 0.15).otherwise(0.0)
        + F.when(has(q, ("priza", "prize")) & has(c, ("priza", "prize")), 0.2).otherwise(0.0)
        + F.when(has(q, ("obligatoriu", "obligatorii")) & has(c, ("trebuie", "obligatoriu")), 0.15).otherwise(0.0)
        + sum((F.when(has(q, (t,)) | has(c, (t,)), 0.1).otherwise(0.0) for t in ("ddr", "diferential", "30 ma", "30ma", "iδn")), F.lit(0.0))
    )
    return F.when(boost > 0, capped(score, boost, 0.5)).otherwise(score)


def citations(candidates: DataFrame, names: DataFrame, most: int, least: float = 0.0) -> DataFrame:
    """Candidates above the threshold with their document's name, numbered in rank order.

    Documents that are not known are called ``Unknown``.
    """
    cited = rank_by(candidates.where(F.col("score") >= least), ["query_id"], F.desc("score"), F.col("doc_id"), F.col("paragraph_number"), most=most, name="citation_index")
    named = cited.join(names.select("doc_id", "document_name"), "doc_id", "left")
    return named.withColumn("document_name", F.coalesce("document_name", F.lit("Unknown")))
