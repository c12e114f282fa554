"""A search pipeline whose parts a settings row turns on and off, with a count for each step.

The plan is built from the settings.  What a step lets through, a few rows for
each question, is written to the shared folder and counted by an observation in
that same pass, so later steps that need it twice do not make it twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docengine.functions import confidence, numeric, text
from docengine.operators import retrieval, trigrams
from docengine.sources import shared


@dataclass(frozen=True)
class Toggles:
    """Parts of the pipeline and its bounds."""

    keyword: bool = True
    vector: bool = True
    synonyms: bool = False
    numbers: bool = False
    optimizer: bool = False
    least: float = 0.4
    most: int = 10
    cited: int = 3
    variants: int = 3
    slack: float = 0.05
    keyword_score: float = 0.45


@dataclass
class StepLog:
    """Rows behind each step."""

    counts: dict[str, int] = field(default_factory=dict)

    def watch(self, step: str, rows: DataFrame) -> DataFrame:
        seen = Observation(step)
        out = shared.saved(rows.observe(seen, F.count(F.lit(1)).alias("rows")), step)
        self.counts[step] = seen.get["rows"]
        return out


def search(questions: DataFrame, vectors: DataFrame, points: DataFrame, docs: DataFrame, index: DataFrame | None, toggles: Toggles, log: StepLog) -> DataFrame:
    """``query_id, citation_index, doc_id, score, confidence`` of a bounded batch of questions.

    ``questions``: ``query_id, text``; ``vectors``: ``query_id, rank, embedding``
    of the question (rank 1) and its variants; ``points``: ``doc_id, embedding``;
    ``docs``: ``doc_id, text``; ``index``: their trigrams, for the keyword part.
    Hits of several variants count once, as the first of them; vector hits go
    before keyword hits of the same document.
    """
    asked = questions.select("query_id", F.col("text").alias("question"))
    variants = retrieval.query_variants(questions, most=toggles.variants) if toggles.synonyms else questions.select("query_id", F.lit(1).cast("long").alias("rank"), F.col("text").alias("variant"))
    variants = log.watch("variants", variants)
    found = []
    if toggles.vector:
        several = variants.groupBy("query_id").agg(F.count("*").alias("n"))
        own = variants.join(vectors, ["query_id", "rank"]).select((F.col("query_id") * toggles.variants + F.col("rank") - 1).alias("query_id"), "embedding")
        near = retrieval.vector_topk(points.withColumnRenamed("doc_id", "point_id"), own, toggles.most, least=toggles.least - toggles.slack)
        near = near.select(F.floor(F.col("query_id") / toggles.variants).alias("query_id"), (F.col("query_id") % toggles.variants).alias("source_rank"), F.col("point_id").alias("doc_id"), "score")
        near = near.join(several, "query_id").where(F.col("score") >= F.when(F.col("n") > 1, toggles.least - toggles.slack).otherwise(toggles.least)).drop("n")
        once = retrieval.merge_lists(near, ["doc_id"], toggles.most)
        found.append(log.watch("vector", once.select("query_id", "doc_id", "score", F.lit(0).alias("source_rank"))))
    if toggles.keyword:
        # a paragraph that holds the whole question holds its words
        held = trigrams.keyword_candidates(index, docs, questions.withColumn("terms", text.search_terms(F.col("text")))).select("query_id", "doc_id").distinct()
        held = retrieval.rank_by(held, ["query_id"], F.col("doc_id"), most=toggles.most)
        found.append(log.watch("keyword", held.select("query_id", "doc_id", F.lit(toggles.keyword_score).alias("score"), F.lit(1).alias("source_rank"))))
    if not found:
        return questions.sparkSession.createDataFrame([], "query_id long, citation_index long, doc_id long, score double, confidence long")
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    both = retrieval.rank_by(both, ["query_id", "doc_id"], F.col("source_rank"), most=1, name="_n").drop("_n")
    both = log.watch("combined", both)
    # the documents that are found, at most a few for each question
    both = both.join(asked, "query_id").join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content")), "doc_id")
    if toggles.numbers:
        wanted = numeric.numeric_question(F.col("question"))
        total = F.aggregate(numeric.measurements(F.col("content")), F.lit(0.0), lambda a, m: a + numeric.match_score(m["value"], m["unit"], F.col("wanted")))
        both = both.withColumn("wanted", wanted).withColumn("score", F.when(F.col("wanted").isNotNull(), F.least(F.lit(1.0), F.col("score") + total / 100)).otherwise(F.col("score"))).drop("wanted")
    cited = retrieval.rank_by(both.where(F.col("score") >= toggles.least), ["query_id"], F.desc("score"), F.col("source_rank"), F.col("doc_id"), most=toggles.cited, name="citation_index")
    cited = log.watch("cited", cited)
    sums = cited.groupBy("query_id").agg(F.avg("score").alias("mean"), F.collect_list("content").alias("evidence"), F.first("question").alias("question"))
    if not toggles.optimizer:
        return cited.join(sums.select("query_id", text.js_round(F.col("mean") * 100).alias("confidence")), "query_id").select("query_id", "citation_index", "doc_id", F.round("score", 6).alias("score"), "confidence")
    case = confidence.scenario(F.col("question"))
    sums = sums.select("query_id", "mean", confidence.coverage(F.col("question"), F.col("evidence")).alias("covered"), confidence.semantic_match(F.col("question"), F.col("evidence")).alias("matched"), *[c.alias(n) for n, c in case.items()])
    sums = sums.select("query_id", "is_practical", confidence.optimized(F.col("mean"), F.col("covered"), F.col("matched"), F.col("complexity"), F.col("is_practical")).alias("confidence"))
    one = F.array("content")
    combined = F.round(F.col("score") * 0.5 + confidence.coverage(F.col("question"), one) * 0.3 + confidence.semantic_match(F.col("question"), one) * 0.2, 6)
    both = cited.join(sums, "query_id").withColumn("combined", F.when(F.col("is_practical"), combined).otherwise(F.lit(0.0)))
    again = retrieval.rank_by(both.withColumnRenamed("citation_index", "before"), ["query_id"], F.desc("combined"), F.col("before"), name="citation_index")
    return again.select("query_id", "citation_index", "doc_id", F.round("score", 6).alias("score"), "confidence")
