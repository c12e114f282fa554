"""Exact dedup by content sort.

Spark samples splitters and range-partitions the normalised texts, an external
sort puts equal texts next to each other, and one pass over each sorted
partition compares every text in full with the one before it.  The sort key
ends with the keeping order, so the first row of a run is the one that stays,
and a group of any size may spread over many partitions: only the first and
last run of a partition are stitched together afterwards, a table with at most
two rows per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import Scratch

_RUNS = "doc_id long, run_id long, run_leader long, run_size long, leads boolean, edge int, part int, text_sha256 string, edge_text string"

#: Characters of a text in the splitters.
HEAD = 64

#: Edge flags of a run: it opens or closes its partition, so that it may continue in another.
_OPENS, _CLOSES = 1, 2


def strip_space(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]`` (null: empty)."""
    out = F.coalesce(text, F.lit(""))
    for ch in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a sorted partition into runs of equal texts."""
    part = TaskContext.get().partitionId()
    run, last, held, sha, text_of_run, opens = 0, None, [], None, None, True

    def out(ids, sizes, run_ids, leaders, leads, edges, shas, edge_text):
        """``edge_text`` is the text of the first row's run, told where that run touches an edge."""
        n = len(ids)
        told = pa.array([edge_text if edges[0] and leads[0] else None], pa.string())
        told = pa.concat_arrays([told, pa.nulls(n - 1, pa.string())])
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(run_ids, pa.int64()), leaders, pa.array(sizes, pa.int64()), pa.array(leads, pa.bool_()), pa.array(edges, pa.int32()), pa.array(np.full(n, part, np.int32)), shas, told],
            names=["doc_id", "run_id", "run_leader", "run_size", "leads", "edge", "part", "text_sha256", "edge_text"],
        )

    def close(edge: int) -> Iterator[pa.RecordBatch]:
        size, leader = sum(map(len, held)), held[0][0]
        for i, ids in enumerate(held):
            n = len(ids)
            leads = np.zeros(n, bool)
            leads[0] = i == 0
            yield out(ids, np.full(n, size), np.full(n, run), pa.array([leader.as_py()] * n, pa.int64()), leads, np.full(n, edge), pa.array([sha] * n, pa.string()), text_of_run)

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        text, ids, shas = batch.column("norm"), batch.column("doc_id"), batch.column("text_sha256")
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is None or text[0].as_py() != last
        last = text[n - 1].as_py()
        cuts = np.flatnonzero(new)
        if len(cuts) == 0:
            held.append(ids)
            continue
        if cuts[0] > 0:
            held.append(ids[: cuts[0]])
        if held:
            yield from close(_OPENS if opens else 0)
            opens, run, held = False, run + 1, []
        lo, hi = cuts[0], cuts[-1]
        if hi > lo:  # runs that begin and end inside this batch
            sizes = np.diff(cuts)
            first = np.repeat(cuts[:-1], sizes)
            edges = np.zeros(hi - lo, np.int64)
            if opens:
                edges[: sizes[0]] = _OPENS
                opens = False
            yield out(ids[lo:hi], np.repeat(sizes, sizes), np.repeat(np.arange(run, run + len(sizes)), sizes), ids.take(pa.array(first)), first == np.arange(lo, hi), edges, shas[lo:hi], text[int(lo)].as_py() if edges[0] else None)
            run += len(sizes)
        held, sha, text_of_run = [ids[hi:]], shas[int(hi)].as_py(), last
    if held:
        yield from close(_CLOSES | (_OPENS if opens else 0))


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose texts are equal once white space is deleted.

    Of equal texts the row with the most code points in its original text
    stays, then the smallest id.  Returns one row per input row: ``doc_id,
    keep_id, group_size, kept, text_sha256``.

    Null texts count as empty, and all empty texts are one group.  A null id
    sorts after all others.  Repeated rows are ordinary members of a group, of
    which exactly one is kept.  Other columns of ``docs`` are not read.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    norm = strip_space(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("size"))
    rows = rows.withColumns({"head": F.left("norm", F.lit(HEAD)), "text_sha256": F.sha2("norm", 256)})
    # Equal texts have equal heads and digests, so both may stand in front of the whole text;
    # the samples from which Spark takes its splitters then stay short.
    keeping = [F.col("size").desc(), F.col("doc_id").asc_nulls_last()]
    in_order = rows.repartitionByRange("head", "text_sha256", *keeping).sortWithinPartitions("head", "text_sha256", "norm", *keeping)
    compared = in_order.select("doc_id", "norm", "text_sha256")
    runs = scratch.save(compared.mapInArrow(_compare_neighbours, _RUNS), "runs")

    # At most two runs of a partition touch its edges; equal ones in a row, compared in full, are one group.
    edge = runs.where("edge > 0 and leads")
    in_turn = Window.orderBy("part", "run_id")
    same = (F.col("text_sha256") == F.lag("text_sha256").over(in_turn)) & (F.col("edge_text") == F.lag("edge_text").over(in_turn))
    edge = edge.withColumn("group_no", F.sum(F.when(same, 0).otherwise(1)).over(in_turn))
    group = Window.partitionBy("group_no").orderBy("part", "run_id")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stitched = edge.select(
        "part",
        "run_id",
        F.first("run_leader").over(whole).alias("group_leader"),
        F.sum("run_size").over(whole).alias("whole_size"),
        (F.row_number().over(group) == 1).alias("group_leads"),
    )
    joined = runs.drop("edge_text").join(F.broadcast(stitched), ["part", "run_id"], "left")
    known = F.col("group_leads").isNotNull()
    return joined.select(
        "doc_id",
        F.when(known, F.col("group_leader")).otherwise(F.col("run_leader")).alias("keep_id"),
        F.coalesce("whole_size", "run_size").alias("group_size"),
        (F.col("leads") & F.coalesce("group_leads", F.lit(True))).alias("kept"),
        "text_sha256",
    )
