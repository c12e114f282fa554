"""Removal of repeated byte strings by distributed prefix doubling.

A string of ``length`` bytes that two documents share is found by ranking
positions by ever longer contexts and dropping a position as soon as its rank
is its document's alone.  Spark sorts (rank, document, position) rows in each
round, and the contexts grow from 16 over 33 to all ``length`` bytes:

* Round 0 ranks *anchors*: in every window of ``length`` bytes the 16-byte
  string of the smallest hash (leftmost of equals).  Equal windows choose the
  same anchor, so no shared window is lost, and one position in about
  seventeen stands for all.  Anchors of one document alone are dropped.
* Round 1 ranks the block of an anchor, the bytes of all windows that chose
  it, as the pair of the ranks of its halves.  A block that a document with a
  smaller id also has is removed whole; that settles the inside of every long
  repeat.
* Round 2 ranks the 33 bytes right and left of each anchor that is left; one
  of them lies inside every window of the anchor.
* Round 3 ranks the single windows of the few anchors at the ends of repeats,
  as pairs of the ranks at the two positions half a window apart.

Rounds 0 and 2 only choose what is ranked further, so an accidental match of
their 64-bit ranks costs a row and nothing else.  Rounds 1 and 3 decide what
is removed; they compare pairs of 64 and 31 bits.

Before each shuffle a task collapses equal ranks among its own rows, so a
string that a third of all documents hold costs a row per task and not per
document.  Rows that a task could settle itself are dealt out evenly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import Scratch
from docengine.llm.textnp import _BASE_INV, BASE, BYTE_VALUE, chunks, powers, splitmix

_U = np.uint64

#: Bytes of the first rank.
GRAM = 16

#: Rows that a task collapses at a time.
BLOCK = 2_000_000

#: The second rank of a row that its own task has settled; second ranks of open rows are not negative.
SETTLED = -1

#: Bits of the second rank of a pair.
_SECOND = _U(0x7FFFFFFF)

Batches = Iterator[pa.RecordBatch]


class Hashes:
    """Hash of any substring of a buffer from one pass over it."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, _U)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, n), out=self.total[1:])
        self.inverse = powers(_BASE_INV, n + 1)

    def __call__(self, lo: np.ndarray, hi: np.ndarray, kind: np.ndarray | int = 0) -> np.ndarray:
        raw = (self.total[hi] - self.total[lo]) * self.inverse[lo]
        return splitmix(raw + np.asarray((hi - lo) * 256 + kind).astype(_U) * _U(0xD1B54A32D192ED03))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def find_anchors(chunk, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, position, first and last window (in the buffer) and hash of each anchor of a chunk."""
    data, width = chunk.data, length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(_U)
    hashes = Hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    key = splitmix((hashes.total[GRAM:] - hashes.total[:-GRAM]) * hashes.inverse[: len(at)])
    # hash first, then the leftmost of equals
    smallest = _sliding_min((key & _U(0xFFFFFFFF00000000)) | at.astype(_U), width)
    window = np.concatenate([np.arange(s, e - length + 1) for s, e in zip(chunk.doc_start.tolist(), chunk.doc_end.tolist(), strict=True) if e - s >= length] or [none])
    anchor = (smallest[window] & _U(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(chunk.doc_start, window, side="right") - 1
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    if len(first) == 0:
        return none, none, none, none, none.view(_U)
    return doc[first], anchor[first], window[first], window[last], key[anchor[first]]


def _pack(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor's position and how far before it its windows begin."""
    return (anchor * 128 + (anchor - first)) * 128 + (anchor - last)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    anchor = at >> 14
    return anchor, anchor - ((at >> 7) & 127), anchor - (at & 127)


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == _U else v) for v in columns.values()], names=list(columns))


def _in_blocks(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part["key"])
        if n >= BLOCK:
            yield {c: np.concatenate([p[c] for p in held]) for c in held[0]}
            held, n = [], 0
    if n:
        yield {c: np.concatenate([p[c] for p in held]) for c in held[0]}


def _collapse(block: dict[str, np.ndarray], settle: str) -> pa.RecordBatch:
    """Sort a task's own rows by rank and settle those that it can.

    ``settle='shared'``: of a rank that two documents here share, one row of
    each of two documents stands for all.  ``settle='smaller'``: a row whose
    rank a smaller document here has is covered.  A settled row needs its rank
    and its other contexts no more; a random rank deals it out evenly.
    """
    block.setdefault("second", np.zeros(len(block["key"]), np.int32))
    by = np.lexsort((block["doc"], block["second"], block["key"]))
    block = {c: v[by] for c, v in block.items()}
    key, second, doc = block["key"], block["second"], block["doc"]
    start = np.ones(len(key), bool)
    start[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
    first = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
    other = doc != doc[first]
    if settle == "shared":
        ends = np.append(np.flatnonzero(start)[1:], len(key)) - 1
        run = np.cumsum(start) - 1
        shared = other[ends][run]
        # the first row and the last, of another document, still tell other tasks
        told = start.copy()
        told[ends] = True
        settled = shared & ~told
    else:
        settled = other
    block["key"] = np.where(settled, splitmix(np.arange(len(key), dtype=_U) + key.view(_U)).view(np.int64), key)
    for c in ("right", "left"):
        if c in block:
            block[c] = np.where(settled, 0, block[c])
    block["second"] = np.where(settled, SETTLED, second).astype(np.int32)
    return _batch({c: block[c] for c in ("key", "second", "doc", "twin", *[c for c in block if c not in ("key", "second", "doc", "twin")])})


def _runs(block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First row of each run of equal pairs of ranks, and the run of each row."""
    key, second = block["key"], block["second"]
    start = np.ones(len(key), bool)
    start[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
    return np.flatnonzero(start), np.cumsum(start) - 1


def _pair_at(block: dict[str, np.ndarray], i: int) -> tuple[int, int]:
    return int(block["key"][i]), int(block["second"][i])


def _open_rows(batches: Batches, columns: list[str]) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]]:
    """Each batch as its settled and its open rows."""
    for batch in batches:
        block = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "second", "doc", "twin", *columns)}
        settled = block["second"] == SETTLED
        yield {c: v[settled] for c, v in block.items()}, {c: v[~settled] for c, v in block.items()}


def _keep_shared(extra: list[str]) -> Callable[[Batches], Batches]:
    """Of rows sorted by (key, second, doc), those of ranks that two documents have.

    Only the run that is still open is held: at most two rows per document and
    task that saw the rank.
    """
    names = ("doc", "twin", *extra)

    def shared(block: dict[str, np.ndarray]) -> pa.RecordBatch:
        first, run = _runs(block)
        last = np.append(first[1:], len(run)) - 1
        yes = (block["doc"][first] != block["doc"][last])[run]
        return _batch({c: block[c][yes] for c in names})

    def run(batches: Batches) -> Batches:
        held: list[dict[str, np.ndarray]] = []
        for settled, block in _open_rows(batches, extra):
            if len(settled["key"]):
                yield _batch({c: settled[c] for c in names})
            if not len(block["key"]):
                continue
            last_run = int(_runs(block)[0][-1])
            if last_run == 0 and held and _pair_at(held[0], 0) == _pair_at(block, 0):
                held.append(block)
                continue
            whole = {c: np.concatenate([h[c] for h in held] + [block[c][:last_run]]) for c in block}
            if len(whole["key"]):
                yield shared(whole)
            held = [{c: v[last_run:] for c, v in block.items()}]
        if held:
            yield shared({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    return run


def _mark_covered(extra: list[str]) -> Callable[[Batches], Batches]:
    """All rows, sorted by (key, second, doc), and whether a smaller document has their rank."""
    names = ("doc", "twin", *extra)

    def run(batches: Batches) -> Batches:
        last, low = None, None
        for settled, block in _open_rows(batches, extra):
            if len(settled["key"]):
                yield _batch({c: settled[c] for c in names} | {"covered": np.ones(len(settled["key"]), bool)})
            if not len(block["key"]):
                continue
            first, of = _runs(block)
            smallest = block["doc"][first]
            if _pair_at(block, 0) == last:
                smallest[0] = low
            covered = block["doc"] > smallest[of]
            # the other contexts of a covered row are needed no more
            block |= {c: np.where(covered, 0, block[c]) for c in ("right", "left") if c in block}
            yield _batch({c: block[c] for c in names} | {"covered": covered})
            last, low = _pair_at(block, -1), smallest[-1]

    return run


def _anchor_rows(length: int) -> Callable[[Batches], Batches]:
    def parts(batches: Batches) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "twin"))
            for chunk in chunks(batch.column("text")):
                doc, anchor, first, last, key = find_anchors(chunk, length)
                begin = chunk.doc_start[doc]
                yield {"key": key.view(np.int64), "doc": ids[chunk.first + doc], "twin": twins[chunk.first + doc], "at": _pack(anchor - begin, first - begin, last - begin)}

    def run(batches: Batches) -> Batches:
        for block in _in_blocks(parts(batches)):
            yield _collapse(block, "shared")

    return run


def _with_positions(batches: Batches) -> Iterator[tuple]:
    """Chunks with the buffer offset, document id, twin and value of each position listed for them."""
    for batch in batches:
        ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "twin"))
        lists = batch.column("at")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()
        for chunk in chunks(batch.column("text")):
            lo, hi = offsets[chunk.first], offsets[chunk.first + chunk.n_docs]
            n = np.diff(offsets[chunk.first : chunk.first + chunk.n_docs + 1])
            doc = np.repeat(np.arange(chunk.n_docs), n)
            yield chunk, chunk.doc_start[doc], ids[chunk.first + doc], twins[chunk.first + doc], values[lo:hi]


def _block_rows(length: int) -> Callable[[Batches], Batches]:
    half = (length - GRAM) // 2

    def parts(batches: Batches) -> Iterator[dict[str, np.ndarray]]:
        for chunk, begin, ids, twins, at in _with_positions(batches):
            anchor, first, last = _unpack(at)
            anchor, first, last = anchor + begin, first + begin, last + begin
            hashes = Hashes(chunk.data)
            middle = (first + last + length) // 2
            key, second = hashes(first, middle, anchor - first), hashes(middle, last + length, anchor - first)
            # Windows that begin at most ``half`` bytes before the anchor hold the bytes right of it, the others those left of it.
            right = hashes(anchor, np.minimum(anchor + length - half, len(chunk.data)), 1)
            left = hashes(np.maximum(anchor - half - 1, 0), anchor + GRAM, 2)
            yield {"key": key.view(np.int64), "second": (second & _SECOND).astype(np.int32), "doc": ids, "twin": twins, "at": at, "right": right.view(np.int64), "left": left.view(np.int64)}

    def run(batches: Batches) -> Batches:
        for block in _in_blocks(parts(batches)):
            yield _collapse(block, "smaller")

    return run


def _half_rows(length: int) -> Callable[[Batches], Batches]:
    half = (length - GRAM) // 2

    def parts(batches: Batches) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            doc, twin, at, right, left = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "twin", "at", "right", "left"))
            anchor, first, last = _unpack(at)
            for key, lo, hi in ((right, np.maximum(first, anchor - half), last), (left, first, np.minimum(last, anchor - half - 1))):
                ok = lo <= hi
                yield {"key": key[ok], "doc": doc[ok], "twin": twin[ok], "at": lo[ok] * 128 + (hi - lo)[ok]}

    def run(batches: Batches) -> Batches:
        for block in _in_blocks(parts(batches)):
            yield _collapse(block, "shared")

    return run


def _window_rows(length: int) -> Callable[[Batches], Batches]:
    def parts(batches: Batches) -> Iterator[dict[str, np.ndarray]]:
        half = length // 2
        for chunk, begin, ids, twins, at in _with_positions(batches):
            lo, n = at >> 7, (at & 127) + 1
            p = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            b = np.repeat(begin, n) + p
            hashes = Hashes(chunk.data)
            key, second = hashes(b, b + half), hashes(b + half, b + length)
            yield {"key": key.view(np.int64), "second": (second & _SECOND).astype(np.int32), "doc": np.repeat(ids, n), "twin": np.repeat(twins, n), "at": p}

    def run(batches: Batches) -> Batches:
        for block in _in_blocks(parts(batches)):
            yield _collapse(block, "smaller")

    return run


def _cut(length: int) -> Callable[[Batches], Batches]:
    """Apply the removed intervals to the texts."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            spans = batch.column("at")
            for chunk in chunks(batch.column("text")):
                for i in range(chunk.n_docs):
                    text = chunk.data[chunk.doc_start[i] : chunk.doc_end[i]]
                    n, row = len(text), chunk.first + i
                    own = spans[row]
                    removed = n_spans = 0
                    if own.is_valid and n:
                        pairs = own.values.to_numpy()
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, pairs >> 8, 1)
                        np.add.at(edge, (pairs >> 8) + (pairs & 255), -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed = int(gone.sum())
                        n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        text = text[~gone]
                    rows.append((n, removed, n_spans, hashlib.sha256(text.tobytes()).hexdigest()))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return run


_RANKED = "key long, second int, doc long, twin long, at long"


def _ranked(rows: DataFrame, keep: str, extra: list[str]) -> DataFrame:
    """Sort by rank and judge; equal open ranks meet in one task, one row of each per task before it."""
    judge = _mark_covered if keep == "smaller" else _keep_shared
    schema = "doc long, twin long, " + ", ".join(f"{c} long" for c in extra) + (", covered boolean" if keep == "smaller" else "")
    return rows.repartition("key").sortWithinPartitions("key", "second", "doc").mapInArrow(judge(extra), schema)


def repeated_substring_cut(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that a smaller document also has.

    Texts are UTF-8 bytes; matches never cross documents; overlaps count, and
    strings are judged on the input.  Returns one row per input row: ``doc_id,
    n_bytes, n_removed, n_spans`` (maximal removed runs), ``kept_sha256`` (the
    remaining bytes one after the other).

    Null texts count as empty.  Rows that share an id are one document, whose
    own repeats do not count; each of them is cut by itself.  A row with a null
    id loses nothing and gives no reason for others to lose.  Other columns are
    not read; an empty table gives an empty result.
    """
    if not 2 * GRAM < length <= 64 + GRAM:
        raise ValueError(f"length must lie between {2 * GRAM + 1} and {64 + GRAM}")
    scratch = Scratch(docs.sparkSession, "suffix")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Where rows share an id, the hash of a row's text tells it from its twins; equal rows have equal positions.
    twins = texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    texts = texts.withColumn("twin", F.xxhash64("text") if twins else F.lit(0).cast("long"))
    gather = F.collect_set if twins else F.collect_list
    known = texts.where("doc_id is not null and octet_length(text) >= " + str(length))
    row = ["doc_id", "twin"]
    pack = lambda rows: rows.groupBy(F.col("doc").alias("doc_id"), "twin").agg(gather("at").alias("at"))

    anchors = _ranked(known.mapInArrow(_anchor_rows(length), _RANKED), "shared", ["at"])
    anchors = scratch.save(anchors, "anchors")
    rows = known.join(pack(anchors), row).mapInArrow(_block_rows(length), _RANKED + ", right long, left long")
    blocks = scratch.save(_ranked(rows, "smaller", ["at", "right", "left"]), "blocks")
    scratch.drop(anchors)

    halves = blocks.where("not covered").mapInArrow(_half_rows(length), _RANKED)
    halves = scratch.save(_ranked(halves, "shared", ["at"]), "halves")
    windows = _ranked(known.join(pack(halves), row).mapInArrow(_window_rows(length), _RANKED), "smaller", ["at"])

    # A removed interval as start * 256 + size.
    anchor = F.shiftright("at", 14)
    begin = anchor - F.shiftright("at", 7).bitwiseAND(127)
    size = anchor - F.col("at").bitwiseAND(127) - begin + length
    inside = blocks.where("covered").select("doc", "twin", (begin * 256 + size).alias("at"))
    gone = scratch.save(inside.unionByName(windows.where("covered").select("doc", "twin", (F.col("at") * 256 + length).alias("at"))), "gone")
    scratch.drop(blocks, halves)
    return texts.join(pack(gone), row, "left").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
