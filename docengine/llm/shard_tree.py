"""Sharding by a hierarchical weighted hash tree.

Shards hang below racks, racks below regions, and an inner node weighs what its
shards weigh.  A row descends from the root: at each level every child draws a
number from the row's key and its own path, divided by its weight, and the
least draw wins.  A child's draw depends on nothing but its path and weight, so
where the weight of one child changes, rows move only to it or away from it:
movement stays inside the subtrees whose weights change, and a subtree that is
new takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import Scratch

#: Hexadecimal digits of a digest in a draw: 52 bits, which a double holds.
DIGITS = 13

#: Parts of a shard that are numbered apart, so that no task sorts a whole shard.
BINS = 1024

#: Most equal rows that one task writes in a row.
PIECE = 4096


class Shard(NamedTuple):
    """A leaf of the tree."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(regions: int, racks: int, shards: int) -> list[Shard]:
    """A tree of equal shards, numbered from 0: ``shards`` in each of ``racks`` in each of ``regions``."""
    return [Shard(f"region{n // (racks * shards)}", f"rack{n // shards}", n) for n in range(regions * racks * shards)]


def with_shard(tree: Iterable[Shard], weight: float = 1.0, region: str | None = None, rack: str | None = None) -> list[Shard]:
    """The tree and one more shard, numbered behind the others.

    By default it has a region of its own, so that it takes rows only into
    itself.  Inside a given region and rack, rows also move between the racks
    and shards of that region, as it weighs more against the others.
    """
    tree = list(tree)
    n = 1 + max((s.shard for s in tree), default=-1)
    return [*tree, Shard(region or f"region-of-{n}", rack or f"rack-of-{n}", n, weight)]


def _children(tree: Iterable[Shard]) -> list[dict[str, dict[str, float]]]:
    """By level: parent's path to the weights of its children by path."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    seen = set()
    for s in tree:
        if s.weight < 0 or s.shard in seen:
            raise ValueError(f"shard {s.shard} has a negative weight or is there twice")
        seen.add(s.shard)
        paths = ["", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"]
        for level, parent, path in zip(levels, paths[:-1], paths[1:], strict=True):
            if s.weight > 0:
                own = level.setdefault(parent, {})
                own[path] = own.get(path, 0.0) + s.weight
    if not levels[0]:
        raise ValueError("a tree needs a shard with a weight")
    return levels


def descend(key: Column, tree: Iterable[Shard]) -> Column:
    """The number of the shard in which a row with this key lies; all null keys are one key."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def pick(children: Column) -> Column:
        def draw(child: Column) -> Column:
            digits = F.conv(F.substring(F.md5(F.concat(child["path"], F.lit("|"), text)), 1, DIGITS), 16, 10).cast("double")
            return F.struct((-F.log((digits + 0.5) / 16.0**DIGITS) / child["weight"]).alias("draw"), child["path"].alias("path"))

        return F.array_min(F.transform(children, draw))["path"]

    def table(own: dict[str, float]) -> Column:
        return F.array(*[F.struct(F.lit(path).alias("path"), F.lit(float(weight)).alias("weight")) for path, weight in own.items()])

    at = F.lit("")
    for level in _children(tree):
        at = pick(F.element_at(F.create_map(*[x for parent, own in level.items() for x in (F.lit(parent), table(own))]), at))
    return F.substring_index(at, "/", -1).cast("int")


def place(docs: DataFrame, tree: Iterable[Shard], grown: Iterable[Shard], id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, piece: int = PIECE) -> DataFrame:
    """The shard of every row, its place there and the shard under a second tree.

    One row per input row: ``doc_id, size`` (UTF-8 bytes and 8), ``text_crc32,
    law`` (``key``), ``shard, slot`` (from 0 without a gap in each shard) and
    ``grown_shard``.  The id alone decides, so equal texts with different ids are
    not held together.

    A null text has no bytes and the checksum of the empty one; rows without an
    id share one draw and lie in one shard.  Repeated rows have slots of their
    own; rows that agree in id, size and checksum are interchangeable and are
    counted before they are shuffled.  Other columns are not read.  An empty
    table gives an empty result; an empty tree, or one without weight, is an
    error.  Reruns give the same rows, whatever the partitions of the input.
    """
    tree, grown = list(tree), list(grown)
    bytes_of = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (bytes_of + 8).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"))
    same = ["doc_id", "size", "text_crc32"]
    counted = rows.groupBy(*same).agg(F.count("*").alias("n"))
    # Written once, narrow, so that the texts are read once.
    counted = Scratch(docs.sparkSession, "shards").save(counted, "counted")
    counted = counted.withColumns({"shard": descend(F.col("doc_id"), tree), "bin": (F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in same])), 1, 8), 16, 10).cast("long") % bins).cast("int")})

    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("shard", "bin").agg(F.sum("n").alias("in_bin"))
    starts = starts.select("shard", "bin", F.coalesce(F.sum("in_bin").over(before), F.lit(0)).alias("start"))
    in_turn = Window.partitionBy("shard", "bin").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = counted.withColumn("upto", F.sum("n").over(in_turn)).join(starts, ["shard", "bin"])
    numbered = numbered.withColumn("slot", F.col("start") + F.col("upto") - F.col("n")).drop("start", "upto", "bin")

    few = numbered.where(F.col("n") <= piece)
    many = numbered.where(F.col("n") > piece).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(piece).cast("long"))))
    many = many.withColumns({"slot": F.col("slot") + F.col("from"), "n": F.least(F.col("n") - F.col("from"), F.lit(piece).cast("long"))}).drop("from")
    both = few.unionByName(many.repartition("shard", "slot"))
    both = both.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1)))
    return both.select(*same, F.lit("key").alias("law"), "shard", "slot", descend(F.col("doc_id"), grown).alias("grown_shard"))
