"""Cutting texts into chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text


def word_chunks(docs: DataFrame, size: int, overlap: int, prefix: str = "[...] ") -> DataFrame:
    """Chunks of ``size`` words, each beginning ``size - overlap`` after the last; later ones are marked."""
    step = size - overlap
    w = docs.select("doc_id", text.words_of(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0)
    rows = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("s"))
    part = F.slice("w", F.col("s") + 1, F.lit(size))
    return rows.select("doc_id", (F.col("s") / step).cast("long").alias("chunk_index"), F.size(part).cast("long").alias("word_count"), F.concat(F.when(F.col("s") > 0, prefix).otherwise(""), F.array_join(part, " ")).alias("content"))


def char_chunks(docs: DataFrame, most: int = 1500, least: int = 200, overlap: int = 100) -> DataFrame:
    """Chunks of ``most`` characters of the collapsed text; shorter than ``least`` are dropped."""
    step = most - overlap
    t = docs.select("doc_id", text.collapse_space(F.coalesce("text", F.lit(""))).alias("t")).where("t <> ''")
    rows = t.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.char_length("t") - 1, F.lit(step))).alias("s"))
    rows = rows.select("doc_id", (F.col("s") / step).cast("long").alias("chunk_index"), F.col("t").substr(F.col("s") + 1, F.lit(most)).alias("content"))
    return rows.withColumn("char_count", F.char_length("content").cast("long")).where(F.col("char_count") >= least)


#: Characters of documents whose chunks a task holds at once.
HELD_CHARS = 1 << 20


def _folded(docs: DataFrame, cut: Callable[[str], Iterator[tuple]], names: tuple[str, ...]) -> DataFrame:
    """``doc_id, chunk_index`` and what ``cut`` makes of each text: whole numbers, and the ``content`` last.

    A task reads its Arrow batches row by row and gives its chunks away
    whenever it has cut some characters, so what it holds does not follow the
    batch's size.
    """
    kinds = [pa.int64()] * (len(names) - 1) + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

        for batch in batches:
            ids, texts = batch.columns
            for at in range(batch.num_rows):
                body, doc_id = texts[at].as_py() or "", ids[at].as_py()
                rows += [(doc_id, i, *c) for i, c in enumerate(cut(body))]
                held += len(body)
                if held >= HELD_CHARS:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    schema = ", ".join(f"{n} {'string' if n == 'content' else 'long'}" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _pack(units: list[str], most: int, least: int, overlap: int, joint: str) -> Iterator[str]:
    """Fill chunks with whole units; each new one begins with the last units that fit in ``overlap``."""
    held, size = [], 0
    for unit in units:
        if held and size + len(unit) + len(joint) > most:
            yield joint.join(held)
            tail, room = [], overlap
            for u in reversed(held):
                if len(u) > room:
                    break
                tail.insert(0, u)
                room -= len(u) + len(joint)
            held, size = tail, sum(len(u) + len(joint) for u in tail)
        held.append(unit)
        size += len(unit) + len(joint)
    if held and (size >= least):
        yield joint.join(held)


def folded_chunks(docs: DataFrame, unit: str = "paragraph", most: int = 1500, least: int = 200, overlap: int = 100) -> DataFrame:
    """Chunks packed from whole sentences or paragraphs: ``doc_id, chunk_index, char_count, word_count, content``.

    Packing depends on what came before, so it is a fold over each document.
    """

    def cut(body: str) -> Iterator[tuple]:
        if unit == "sentence":
            units = [s.strip() for s in re.findall(r"[^.!?]+[.!?]*", " ".join(body.split()))]
        else:
            units = [" ".join(p.split()) for p in body.split("\n")]
        for chunk in _pack([u for u in units if u], most, least, overlap, " " if unit == "sentence" else "\n"):
            yield len(chunk), len(chunk.split()), chunk

    return _folded(docs, cut, ("doc_id", "chunk_index", "char_count", "word_count", "content"))


def with_previous_tail(chunks: DataFrame, tail: int) -> DataFrame:
    """Each chunk after the end of the one before it."""
    before = F.lag("content").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    joined = F.when(before.isNotNull(), F.concat(F.right(before, F.lit(tail)), F.lit(" "), F.col("content"))).otherwise(F.col("content"))
    return chunks.withColumn("content", joined).withColumn("char_count", F.char_length("content").cast("long"))


def sentence_page_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100, page_chars: int = 3000) -> DataFrame:
    """Chunks of whole sentences, each beginning with the last words of the one before: ``doc_id, chunk_index, page_number, content``.

    A chunk is closed by the sentence that would make it longer than ``size``,
    and begins anew with a fifth of ``overlap`` words; its page is counted from
    the sentences that came before.  A fold over each document.
    """

    def one(body: str) -> Iterator[tuple[int, str]]:
        held, seen = "", 0
        for sentence in re.split(r"(?<=[.!?])\s+", body):
            if len(held) + len(sentence) > size:
                yield seen // page_chars + 1, held.strip()
                held = " ".join(held.split(" ")[-(overlap // 5) :]) + " " + sentence
            else:
                held += " " + sentence
            seen += len(sentence)
        if held.strip():
            yield seen // page_chars + 1, held.strip()

    return _folded(docs, one, ("doc_id", "chunk_index", "page_number", "content"))


def best_sentences(docs: DataFrame, asked: DataFrame, longer_than: int = 20) -> DataFrame:
    """The sentence of each document with the most words of each question, the first of equals: ``query_id, doc_id, score, sentence_sha``.

    ``asked``: a bounded ``query_id, ws``, words in lower case.  A task settles
    each row of documents by itself and sends the digest of its best sentence
    alone; rows that share an id are settled by that.
    """
    kept = F.filter(text.sentences(F.coalesce("text", F.lit(""))), lambda x: F.char_length(x) > longer_than)
    s = docs.select("doc_id", kept.alias("ss")).select("doc_id", "ss", F.transform("ss", lambda x: F.lower(x)).alias("low")).join(F.broadcast(asked))
    each = F.transform("low", lambda x, i: F.struct(F.size(F.filter("ws", lambda w: F.contains(x, w))).cast("long").alias("score"), (-i).alias("at")))
    top = s.select("query_id", "doc_id", "ss", F.array_max(each).alias("top"))
    own = F.struct(F.col("top.score").alias("score"), F.col("top.at").alias("at"), F.sha2(F.get("ss", -F.col("top.at")), 256).alias("sha"))
    best = top.select("query_id", "doc_id", own.alias("own")).groupBy("query_id", "doc_id").agg(F.max("own").alias("best"))
    # a document without sentences has none
    return best.where("best.score is not null").select("query_id", "doc_id", F.col("best.score").alias("score"), F.col("best.sha").alias("sentence_sha"))
