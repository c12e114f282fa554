"""Vector search in cells: the exact best points of a query from a part of the points.

Directions are dealt to the nearest of some centres, which are fitted on a
bounded sample; every point is stored by its cell, and each cell has a radius,
the greatest angle to its centre.  A query looks into the cells of the nearest
centres first.  No point of a cell is nearer than the angle to the centre less
the radius, so the k-th score found tells which other cells may hold a better
one; those are looked into next, and the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.operators.retrieval import QUERY_BLOCK, rank_by
from docengine.sources import shared

#: Most points on which the centres are fitted, rounds of the fit, and most centres.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 10, 4096

#: Cells that a query looks into before the bound is known.
FIRST = 4

#: Parts of a cell, so that a cell of a third of all points is written by several tasks.
SALTS = 8

#: Scores are rounded to so many digits; ties go to the smaller id.
DIGITS = 6

#: The cell of the points of length zero, whose score is 0 for every query.
NOWHERE = -1


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def fit_centres(points: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means: ``n`` centres at most; a centre without points stays where it is."""
    unit = _unit(points[np.linalg.norm(points, axis=1) > 0])
    if not len(unit):
        return np.zeros((0, points.shape[1] if points.ndim == 2 else 0))
    unit = np.unique(unit, axis=0)
    centres = unit[np.random.default_rng(seed).permutation(len(unit))[:n]]
    for _ in range(ROUNDS):
        nearest = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        moved = np.linalg.norm(sums, axis=1) > 0
        centres[moved] = _unit(sums[moved])
    return centres


def _vectors(batch: pa.RecordBatch, width: int | None = None) -> np.ndarray:
    lists = batch.column("embedding")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes != (width or sizes[0])).any():
        raise ValueError("vectors must have the same length")
    return flat.reshape(batch.num_rows, -1)


def _dealt(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, centres.shape[1] or None)
            zero = np.linalg.norm(x, axis=1) == 0
            if len(centres):
                near = _unit(x) @ centres.T
                cell = np.where(zero, NOWHERE, np.argmax(near, axis=1))
                angle = np.arccos(np.clip(near.max(axis=1), -1, 1))
            else:
                cell, angle = np.full(len(x), NOWHERE), np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    return run


@dataclass
class Cells:
    """Points by cell, the centres, and each cell's radius."""

    table: DataFrame
    centres: np.ndarray
    radius: dict[int, float]
    probed: list[int] = field(default_factory=list)  # cells of each round of the last search


def build(points: DataFrame, path: str, n_cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """Deal ``point_id, embedding`` and all other columns to cells and write them.

    A null vector is in no cell and is never found.  Vectors of different lengths are an error.
    """
    spark = points.sparkSession
    given = points.where("embedding is not null")
    n = given.count()
    few = np.array([r[0] for r in given.orderBy(F.xxhash64("point_id"), "point_id").select("embedding").limit(sample).collect()], dtype=np.float64)
    centres = fit_centres(few, n_cells or max(1, min(MOST_CELLS, round(n**0.5)))) if n else np.zeros((0, 0))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in given.dtypes) + ", cell int, angle double"
    dealt = given.mapInArrow(_dealt(centres), schema)
    dealt = dealt.repartition("cell", F.pmod(F.xxhash64("point_id"), F.lit(SALTS))).sortWithinPartitions("cell")
    dealt.write.partitionBy("cell").parquet(path)
    order = [*(c for c in dealt.columns if c != "cell"), "cell"]
    table = spark.read.schema(dealt.select(*order).schema).parquet(path)
    return Cells(table, centres, {r["cell"]: r["r"] for r in table.groupBy("cell").agg(F.max("angle").alias("r")).collect()})


_OPEN: dict[str, Cells] = {}


def open_cells(points: DataFrame, source: str) -> Cells:
    """The cells of a table, which a session builds once; ``source`` names the table."""

    def make(path: str) -> None:
        _OPEN[path] = build(points, path)

    return _OPEN[shared.built_once(points.sparkSession, "cells", source, make)]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by id."""
    if len(scores) > k:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]


def _look(names: list[int], unit: np.ndarray, by_cell: dict[int, np.ndarray], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cell, x = batch.column("point_id").to_numpy(zero_copy_only=False), batch.column("cell").to_numpy(), _unit(_vectors(batch, unit.shape[1]))
            for c in np.unique(cell):
                rows, asking = np.flatnonzero(cell == c), by_cell.get(int(c), ())
                if not len(asking):
                    continue
                scores = np.round(unit[asking] @ x[rows].T, DIGITS) + 0.0
                for q, own in zip(asking, scores, strict=True):
                    a, b = found.get(q, (ids[:0], own[:0]))
                    a, b = np.concatenate((a, ids[rows])), np.concatenate((b, own))
                    best = _best(a, b, k)
                    found[q] = a[best], b[best]
        for q, (a, b) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), names[q])), pa.array(a), pa.array(b)], names=["query_id", "point_id", "score"])

    return run


def topk(cells: Cells, queries: DataFrame, k: int, least: float = -1.0, where: Column | None = None, first: int = FIRST, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` points of each query with the greatest cosine, at least ``least``: ``query_id, point_id, score, rank``.

    The same rows as :func:`retrieval.vector_topk` gives.  ``where`` is a filter
    on the points' columns, applied before the best are taken.  Queries, with
    different ids, are read to the driver in blocks of about ``block``; for each block two
    scans read the cells that one of its queries looks into, and no others.
    """
    spark = queries.sparkSession
    empty = spark.createDataFrame([], "query_id long, point_id long, score double, rank long")
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    blocks = max(1, -(-asked.count() // block))
    parts, cells.probed = [], []
    points = cells.table if where is None else cells.table.where(where)

    def scan(names, unit, wanted: dict[int, np.ndarray]) -> DataFrame:
        cells.probed.append(len(wanted))
        near = points.where(F.col("cell").isin(*wanted)) if wanted else points.where(F.lit(False))
        rows = near.select("point_id", "cell", "embedding").mapInArrow(_look(names, unit, wanted, k), "query_id long, point_id long, score double")
        return rows.where(F.col("score") >= least)

    for b in range(blocks):
        rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
        if not rows or not cells.radius:
            continue
        names, raw = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
        unit = _unit(raw)
        known = np.array(sorted(cells.radius))
        real = known[known >= 0]
        bound = np.zeros((len(names), len(known)))  # no score in a cell is above it
        angle = np.full(bound.shape, np.pi)
        if len(real):
            own = np.arccos(np.clip(unit @ cells.centres[real].T, -1, 1))
            nearest = np.maximum(0, own - np.array([cells.radius[int(c)] for c in real]))
            angle[:, known >= 0] = own
            bound[:, known >= 0] = np.where((np.linalg.norm(raw, axis=1) == 0)[:, None], 0, np.cos(nearest))
        looked = np.zeros(bound.shape, bool)
        np.put_along_axis(looked, np.argsort(angle, axis=1, kind="stable")[:, :first], True, axis=1)

        def by_cell(mask, known=known):
            return {int(c): np.flatnonzero(mask[:, i]) for i, c in enumerate(known) if mask[:, i].any()}

        one = shared.saved(rank_by(scan(names, unit, by_cell(looked)), ["query_id"], F.desc("score"), F.col("point_id"), most=k).drop("rank"), "found")
        kth = {r["query_id"]: r["s"] for r in one.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
        floor = np.array([max(least, kth.get(q, -2.0)) for q in names])
        more = ~looked & (bound + 2 * 10.0**-DIGITS >= floor[:, None])
        two = scan(names, unit, by_cell(more))
        parts.append(rank_by(one.unionByName(two), ["query_id"], F.desc("score"), F.col("point_id"), most=k))
    for part in parts:
        empty = empty.unionByName(part)
    return empty
