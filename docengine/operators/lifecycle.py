"""Events folded to states: the last snapshot of each key and the events after it.

A document is pending, in processing, completed or failed.  An event is a map of
states to states, and maps can be put together in any grouping, so the events of
a key are folded in pieces, each for all states that it may begin in, and the
pieces then in order; a snapshot is the state that the later events begin in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States by number.
STATES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")

#: What an event leads to from each state; -1 where it is not allowed, and the state stays. Fixed values.
LEADS = {
    "start": (1, -1, -1, -1),
    "add": (-1, 1, -1, -1),
    "complete": (-1, 2, -1, -1),
    "fail": (3, 3, 3, 3),
}

#: Events of a key in one piece.
PIECE = 512


def _maps() -> Column:
    return F.create_map(*[x for name, to in LEADS.items() for x in (F.lit(name), F.array(*[F.lit(t) for t in to]))])


def fold(events: DataFrame, snapshots: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """``key, state, n_events, illegal, last_place``: where each key's events lead from its snapshot, or from pending.

    ``events``: ``key, place, name``; places of a key differ and give the order.
    ``snapshots``: what this function gave for earlier events; of several of a
    key the last counts, and only events behind it are folded.  An event that
    its state does not allow, or whose name is not known, is counted and
    changes nothing.  A key without events keeps its snapshot.
    """
    spark = events.sparkSession
    if snapshots is None:
        snapshots = spark.createDataFrame([], "key long, state string, n_events long, illegal long, last_place long")
    last = snapshots.groupBy("key").agg(F.max_by(F.struct("state", "n_events", "illegal", "last_place"), "last_place").alias("s")).select("key", "s.*")
    later = events.join(last.select("key", F.col("last_place").alias("done")), "key", "left").where(F.col("done").isNull() | (F.col("place") > F.col("done")))
    w = Window.partitionBy("key").orderBy("place")
    rows = later.select("key", "place", F.coalesce(F.try_element_at(_maps(), F.col("name")), F.array(*[F.lit(-1)] * len(STATES))).alias("to"), F.floor((F.row_number().over(w) - 1) / piece).alias("piece"))
    pieces = rows.groupBy("key", "piece").agg(F.array_sort(F.collect_list(F.struct("place", "to"))).alias("es"), F.max("place").alias("last"), F.count("*").alias("n"))
    begin = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(0).alias("bad")) for i in range(len(STATES))])

    def step(acc: Column, e: Column) -> Column:
        to = lambda s: F.get(e["to"], s["at"])
        return F.transform(acc, lambda s: F.struct(F.when(to(s) < 0, s["at"]).otherwise(to(s)).alias("at"), (s["bad"] + (to(s) < 0).cast("int")).alias("bad")))

    pieces = pieces.select("key", "piece", F.aggregate("es", begin, step).alias("map"), "last", "n")
    whole = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "map"))).alias("maps"), F.max("last").alias("last"), F.sum("n").alias("n"))
    number = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.coalesce("state", F.lit(STATES[0]))).cast("int") - 1

    def through(acc: Column, p: Column) -> Column:
        to = F.get(p["map"], acc["at"])
        return F.struct(to["at"].alias("at"), (acc["bad"] + to["bad"]).alias("bad"))

    both = last.join(whole, "key", "full")
    end = F.aggregate(F.coalesce("maps", F.array().cast("array<struct<piece:bigint,map:array<struct<at:int,bad:int>>>>")), F.struct(number.alias("at"), F.coalesce("illegal", F.lit(0)).cast("int").alias("bad")), through)
    both = both.withColumn("end", end)
    return both.select(
        "key",
        F.get(F.array(*[F.lit(s) for s in STATES]), F.col("end.at")).alias("state"),
        (F.coalesce("n_events", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("n_events"),
        F.col("end.bad").cast("long").alias("illegal"),
        F.coalesce("last", "last_place").alias("last_place"),
    )
