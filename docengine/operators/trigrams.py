"""An index of character trigrams: which documents hold a term, without looking through all of them.

Each trigram of a document's text in lower case is a number made of its three
code points.  Tasks turn their documents into postings, a trigram with the ids
of a chunk of documents that hold it, and postings are stored by a hash of the
trigram.  A term is in no document that lacks one of its trigrams; the postings
of its rarest ones are intersected, and what is left is verified in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.operators import retrieval
from docengine.sources import shared
from docengine.sources.tables import paragraphs

#: Folders of the index; a term's trigrams lie in a few of them.
BUCKETS = 32

#: Parts of a folder: a trigram that most documents hold is written by several tasks.
SALTS = 4

#: Characters whose documents share postings.
CHUNK = 1 << 21

#: Bytes of a table that one task reads at least.
SPLIT = 32 << 20

#: Postings of a term that are intersected, the rarest first.
RAREST = 3

#: Fewest characters of a term that the index knows.
SHORTEST = 3

#: Bits of a code point.
_BITS = 21


def _grams(text: str) -> np.ndarray:
    """The different trigrams of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) < SHORTEST:
        return np.zeros(0, np.int64)
    gram = points[2:].astype(np.int64)
    for before in (points[1:-1], points[:-2]):
        gram <<= _BITS
        gram |= before
    gram.sort()
    return gram[np.append(True, gram[1:] != gram[:-1])]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings chunk by chunk; of its documents a task holds one text and the different trigrams of a chunk."""
    ids, grams, held, piece = [], [], 0, 0

    def flush() -> pa.RecordBatch:
        gram = np.concatenate(grams)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(g) for g in grams])
        grams.clear()
        order = np.argsort(gram, kind="stable")  # documents stay in order
        gram, doc = gram[order], doc[order]
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        ends = np.append(starts, len(gram)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int64()).take(pa.array(doc)))
        return pa.RecordBatch.from_arrays([pa.array(gram[starts]), pa.array(np.full(len(starts), piece, np.int32)), pa.array(np.diff(ends).astype(np.int64)), lists], names=["gram", "piece", "n", "ids"])

    for batch in batches:
        at, texts = batch.column("doc_id"), batch.column("low")
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            ids.append(at[i].as_py())
            grams.append(_grams(text))
            held += len(text)
            if held >= CHUNK:
                yield flush()
                ids, held, piece = [], 0, piece + 1
    if ids:
        yield flush()


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, path: str) -> None:
    """Write the index of ``doc_id, text``: ``gram, n, ids`` by ``bucket``.

    Null texts are empty; a null id is indexed as null; a document without three
    characters has no posting.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    # A table of fewer splits than there are cores, which one task or a few would read, is dealt out first.
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SPLIT:
        rows = rows.repartition(cores)
    found = rows.mapInArrow(_postings, "gram long, piece int, n long, ids array<long>").withColumn("bucket", _bucket(F.col("gram")))
    dealt = found.repartition("bucket", F.pmod(F.col("piece") + F.spark_partition_id(), F.lit(SALTS))).drop("piece")
    dealt.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def open_index(docs: DataFrame, source: str) -> DataFrame:
    """The index of a table, which a session builds once; ``source`` names the table."""
    spark = docs.sparkSession
    path = shared.built_once(spark, "trigrams", source, lambda p: build(docs, p))
    return spark.read.schema("gram long, n long, ids array<long>, bucket int").parquet(path)


def grams_of(term: Column) -> Column:
    """The different trigrams of a term as numbers."""
    letters = F.filter(F.split(term, ""), lambda c: c != "")
    point = lambda i: F.ascii(F.get(letters, i)).cast("long")
    one = lambda i: point(i).bitwiseOR(F.shiftleft(point(i + 1), _BITS)).bitwiseOR(F.shiftleft(point(i + 2), 2 * _BITS))
    return F.when(F.size(letters) >= SHORTEST, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(letters) - SHORTEST), one))).otherwise(F.array().cast("array<long>"))


def holding(index: DataFrame, terms: DataFrame, rarest: int = RAREST) -> DataFrame:
    """``term, doc_id`` of the documents that hold the rarest trigrams of each term of a bounded table, perhaps the term."""
    own = terms.select("term", F.explode(grams_of(F.col("term"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    sizes = index.join(F.broadcast(own), ["bucket", "gram"]).groupBy("term", "gram", "bucket").agg(F.sum("n").alias("n"))
    whole = own.groupBy("term").agg(F.count("*").alias("grams"))
    ranked = retrieval.rank_by(sizes.join(F.broadcast(whole), "term"), ["term"], F.col("n"), F.col("gram"))
    # A term one of whose trigrams is nowhere is nowhere.
    known = ranked.groupBy("term").agg(F.count("*").alias("found"))
    picked = ranked.join(known, "term").where("found = grams").where(F.col("rank") <= rarest)
    picked = picked.select("term", "gram", "bucket", F.least(F.col("grams"), F.lit(rarest)).alias("wanted"))
    lists = index.join(F.broadcast(picked), ["bucket", "gram"]).select("term", "wanted", "gram", F.explode("ids").alias("doc_id"))
    # Documents with one id may have their trigrams in postings of their own.
    return lists.groupBy("term", "doc_id").agg(F.first("wanted").alias("wanted"), F.count_distinct("gram").alias("held")).where("held = wanted").select("term", "doc_id")


def keyword_candidates(index: DataFrame, docs: DataFrame, queries: DataFrame, score: float | None = None) -> DataFrame:
    """Paragraphs that hold a term of a query, as :func:`retrieval.keyword_candidates` finds them, through the index.

    Queries with a term of fewer than three characters look through all paragraphs.
    """
    short = F.exists("terms", lambda t: F.char_length(t) < SHORTEST)
    asked = queries.select("query_id", "terms")

    def ask(block: DataFrame) -> DataFrame:
        each = block.select("query_id", "terms", F.explode(F.array_distinct("terms")).alias("term"))
        found = holding(index, each.select("term").distinct())
        # no more terms than a query has
        maybe = found.join(F.broadcast(each), "term").groupBy("query_id", "doc_id").agg(F.first("terms").alias("terms"), F.collect_set("term").alias("maybe"))
        ids = found.select("doc_id").distinct()
        near = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
        low = paragraphs(near).withColumn("low", F.lower("content"))
        both = low.join(maybe.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")))
        here = F.filter("maybe", lambda t: F.contains("low", t))
        # a term that a query repeats counts as often
        hits = F.size(F.filter("terms", lambda t: F.array_contains("here", t))).cast("long")
        return both.withColumn("here", here).where(F.size("here") > 0).withColumn("hits", hits).select("query_id", "doc_id", "paragraph_number", "content", "hits", F.size("terms").alias("n_terms"))

    out = retrieval.in_blocks(asked.where(~short), ask)
    value = F.lit(score) if score is not None else F.col("hits") / F.col("n_terms")
    out = out.select("query_id", "doc_id", "paragraph_number", "content", "hits", value.cast("double").alias("score"))
    if asked.where(short).limit(1).count():
        out = out.unionByName(retrieval.keyword_candidates(paragraphs(docs), asked.where(short), score))
    return out
