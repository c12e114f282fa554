"""A trie over the turns of conversations, summed up by pointer jumping.

A node is a distinct sequence of first turns.  Its key is made of the depth and
two prefix sums of the turns' digests, ``sum(digest[i] * BASE**i)`` modulo 2^64,
so the key of the parent is known in the same row and a conversation may be
spread over many partitions: sums of a partition are local and are put together
from the last rows at the partitions' edges.

What the nodes below a node add up to is found in rounds.  In round k every
node hands its sum to the ancestor 2^k levels above and then points at that
one's pointer, so after as many rounds as the depth has binary digits every
node holds the sum over its whole subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import Scratch
from docengine.llm.textnp import BASE, powers

_U = np.uint64

#: Bytes of a node's key: depth and two sums.
_KEY = 24

ROOT = bytes(_KEY)

#: Bytes of one piece of the list of conversations that end at a node.
PIECE = 1 << 20

_RUN = "conv_id long, digest binary, n_bytes long, part int, edge boolean, depth long, s1 long, s2 long, p1 long, p2 long"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, n_bytes`` of every turn: a digest of role and text and the text's UTF-8 bytes.

    A null role or text is empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(whole, 256), 1, 32))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth and prefix sums of the rows of a sorted partition, each conversation from its first row here.

    ``edge`` marks the last row of a conversation that opens or closes the partition.
    """
    part = TaskContext.get().partitionId()
    conv, depth, sums, opening, held = None, 0, np.zeros(2, _U), True, None

    def batch_of(columns: dict, lo: int, hi: int, edge: np.ndarray) -> pa.RecordBatch:
        own = {k: v[lo:hi] for k, v in columns.items()}
        own |= {"part": pa.array(np.full(hi - lo, part, np.int32)), "edge": pa.array(edge)}
        names = [x.split()[0] for x in _RUN.split(", ")]
        return pa.RecordBatch.from_arrays([own[k] for k in names], names=names)

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), _U).reshape(n, 2)
        new = np.ones(n, bool)
        new[1:] = ids[1:] != ids[:-1]
        goes_on = conv is not None and ids[0] == conv
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        local = np.arange(n) - begin
        term = digest * powers(BASE, n)[local][:, None]
        upto = np.cumsum(term, axis=0, dtype=_U)
        head = np.where((begin > 0)[:, None], upto[np.maximum(begin - 1, 0)], _U(0))
        own = upto - head
        depths = local + 1
        first = begin == 0
        if goes_on:
            own[first] = own[first] * _U(pow(BASE, depth, 2**64)) + sums
            depths = np.where(first, depths + depth, depths)
            term[first] = term[first] * _U(pow(BASE, depth, 2**64))
        columns = {c: batch.column(c) for c in ("conv_id", "digest", "n_bytes")} | {"depth": pa.array(depths), "s1": _signed(own[:, 0]), "s2": _signed(own[:, 1]), "p1": _signed(own[:, 0] - term[:, 0]), "p2": _signed(own[:, 1] - term[:, 1])}
        ends = np.append(new[1:], False)  # of all rows but the last, which waits for the next batch
        if held is not None:
            yield batch_of(held[0], held[1], held[1] + 1, np.array([opening and not goes_on]))
        if held is not None and not goes_on:
            opening = False
        edge = ends & first & opening
        if ends.any():
            opening = False
        if n > 1:
            yield batch_of(columns, 0, n - 1, edge[:-1])
        held = (columns, n - 1)
        conv, depth, sums = ids[-1], int(depths[-1]), own[-1]
    if held is not None:
        yield batch_of(held[0], held[1], held[1] + 1, np.array([True]))


def _stitched(parts: pd.DataFrame) -> pd.DataFrame:
    """What comes before a conversation in each of its partitions; one row a partition."""
    parts = parts.sort_values("part")
    depth, sums, out = 0, [0, 0], []
    for row in parts.itertuples():
        out.append((row.conv_id, row.part, depth, *(int(np.array(s, _U).view(np.int64)) for s in sums)))
        step = pow(BASE, depth, 2**64)
        sums = [(s + step * own) % 2**64 for s, own in zip(sums, (row.s1, row.s2), strict=True)]
        depth += row.depth
    return pd.DataFrame(out[1:], columns=["conv_id", "part", "more", "a1", "a2"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of node and parent, whole over all partitions of a conversation."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        more = batch.column("more").to_numpy()
        moved = np.flatnonzero(more)
        step = np.ones(n, _U)
        step[moved] = [pow(BASE, int(d), 2**64) for d in more[moved]]
        depth = batch.column("depth").to_numpy() + more

        def key(at, columns, depth=depth, batch=batch, step=step, n=n):
            words = np.empty((n, 3), ">u8")
            words[:, 0] = depth + at
            for i, (name, before) in enumerate(zip(columns, ("a1", "a2"), strict=True)):
                own, ahead = (batch.column(c).to_numpy().view(_U) for c in (name, before))
                words[:, 1 + i] = ahead + step * own
            words[words[:, 0] == 0] = 0
            return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY), n, [None, pa.py_buffer(words.tobytes())]).cast(pa.binary())

        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("n_bytes"), pa.array(depth), key(0, ("s1", "s2")), key(-1, ("p1", "p2"))], names=["conv_id", "n_bytes", "depth", "node", "parent"])


def _runs(turns: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """Every row with its depth and sums in its partition (``depth, s1, s2, p1, p2``) and what lies before (``more, a1, a2``)."""
    # The row's number lets equal rows spread over partitions; they are interchangeable.
    keys = ["conv_id", *order, "at"]
    ordered = turns.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = scratch.save(ordered.select("conv_id", "digest", "n_bytes").mapInArrow(_running, _RUN), "runs")
    # One row for each conversation that goes on in another partition: at most one a partition.
    edges = local.where("edge").select("conv_id", "part", "depth", "s1", "s2")
    ahead = edges.groupBy("conv_id").applyInPandas(_stitched, "conv_id long, part int, more long, a1 long, a2 long")
    return local.drop("edge").join(F.broadcast(ahead), ["conv_id", "part"], "left").fillna(0, ["more", "a1", "a2"])


def prefixes(turns: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """``conv_id, n_bytes, depth`` (from 1), ``node, parent`` of every row of ``conv_id, digest, n_bytes`` in the given order."""
    whole = _runs(turns, order, scratch).drop("digest", "part")
    return scratch.save(whole.mapInArrow(_keyed, "conv_id long, n_bytes long, depth long, node binary, parent binary"), "prefixes")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each node of a sorted partition as text, in pieces."""
    part = TaskContext.get().partitionId()
    node, ids, size, number, out = None, [], 0, 0, []

    def cut():
        nonlocal ids, size, number
        out.append((node, part, number, ",".join(ids)))
        ids, size, number = [], 0, number + 1

    def flush():
        rows = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.binary(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["node", "part", "number", "ids"])

    for batch in batches:
        for key, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (key != node or size > PIECE):
                cut()
            node = key
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if out:
            yield flush()
    if ids:
        cut()
    if out:
        yield flush()


def _joined_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, joined by commas."""
    node, sha, out = None, None, []

    def flush():
        nodes, shas = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(shas, pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").cast(pa.binary()).to_pylist(), strict=True):
            if key != node:
                if sha is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids)
            else:
                sha.update(b",")
                sha.update(ids)
        if out:
            yield flush()
    if sha is not None:
        out.append((node, sha.hexdigest()))
        yield flush()


def subtree_sums(nodes: DataFrame, scratch: Scratch, values: list[str], depth: int) -> DataFrame:
    """``node`` and its ``values`` summed over its subtree; ``nodes`` has ``node, parent, depth`` and the values.

    One round for each binary digit of ``depth``, the greatest one.
    """
    state = scratch.save(nodes.select("node", "depth", F.col("parent").alias("jump"), *values), "round")
    step = 1
    while step <= depth:
        handed = state.where("jump is not null").groupBy("jump").agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        summed = state.join(handed.withColumnRenamed("jump", "node"), "node", "left")
        summed = summed.select("node", "depth", "jump", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
        if 2 * step <= depth:
            further = state.where("jump is not null").select(F.col("node").alias("via"), F.col("jump").alias("further"))
            # Nodes whose way ends here look for nothing, each under a name of its own.
            via = F.when(F.col("depth") >= 2 * step, F.col("jump")).otherwise(F.concat("node", F.lit(b"-")))
            summed = summed.withColumn("via", via).join(further, "via", "left").select("node", "depth", F.col("further").alias("jump"), *values)
        done = scratch.save(summed, "round")
        scratch.drop(state)
        state, step = done, 2 * step
    return state.select("node", *values)


def prefix_trie(turns: DataFrame, conversations: DataFrame, order: list[Column]) -> DataFrame:
    """The nodes of the trie over the first turns of all conversations.

    ``turns`` has ``conv_id, digest, n_bytes`` and what ``order`` names, the
    order of a conversation's turns (:func:`turn_rows` makes them);
    ``conversations`` has the ``conv_id`` of all conversations, those without a
    turn too.  One row per node: ``conv_id`` (the smallest member), ``depth,
    parent_conv_id`` (root: null), ``n_convs`` (members: conversations that
    begin with it), ``n_children, n_leaves`` (nodes without children in its
    subtree, itself included), ``saved_tokens`` (over its subtree, each node's
    bytes for all members but one) and ``ends_sha256`` (over the ids of the
    members that end at it, in order, joined by commas).

    Rows without a conversation's id belong to none and are left out.  Rows that
    ``order`` does not tell apart are in any order, so it should name all that
    matters.  Repeated rows are turns of their own; empty texts are turns of no
    bytes.  Other columns are not read.  Without a conversation there is no node.

    The list under a digest is hashed in order by one task, from pieces of 1 MB
    that many tasks make.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    members = prefixes(turns.where("conv_id is not null"), order, scratch)
    every = scratch.save(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), "conversations")

    grown = members.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    root = every.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    plain = scratch.save(grown.unionByName(root), "nodes")
    children = plain.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = plain.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")})
    nodes = scratch.save(nodes, "nodes")
    sums = subtree_sums(nodes, scratch, ["n_leaves", "saved_tokens"], nodes.agg(F.max("depth")).first()[0] or 0)

    last = members.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = every.join(last, "conv_id", "left").select(F.coalesce("node", F.lit(ROOT)).alias("node"), "conv_id")
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node binary, part int, number long, ids string")
    digests = pieces.repartition("node").sortWithinPartitions("node", "part", "number").select("node", "ids").mapInArrow(_joined_digest, "node binary, ends_sha256 string")

    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, "node").join(digests, "node", "left")
    # The root's way up is a name that nothing has, so no key is null.
    out = out.withColumn("parent", F.coalesce("parent", F.lit(b"-"))).join(above, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def share_heads(conversations: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations of which those of a family begin alike: turns and ids for :func:`prefix_trie`, and the order's columns.

    Conversation c has the first h turns of conversation ``c - c % family`` (all
    if that has fewer, none if there is no such one) and then its own turns
    after its first h; h is the checksum of c modulo ``most``.  The order is
    ``whose`` (0: the family's), ``depth``.
    """
    scratch = Scratch(conversations.sparkSession, "heads")
    rows = turn_rows(conversations).where("conv_id is not null")
    ids = scratch.save(rows.select("conv_id").distinct(), "ids")
    runs = _runs(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], scratch)
    whole = runs.select("conv_id", "digest", "n_bytes", (F.col("depth") + F.col("more")).alias("depth"))
    share = F.crc32(F.col("conv_id").cast("string")) % most
    own = whole.where(F.col("depth") > share).withColumn("whose", F.lit(1))
    kin = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), share.alias("share"))
    heads = whole.where(F.col("depth") < most).withColumnRenamed("conv_id", "base")
    lent = heads.join(kin, "base").where("depth <= share").select("conv_id", "digest", "n_bytes", "depth", F.lit(0).alias("whose"))
    return own.unionByName(lent), ids
