"""Operational state: rate limits, caches, ledgers, queues and document states."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

State = TypeVar("State")

#: Tokens that operations cost. Fixed values.
COSTS = {"query": 1, "upload": 5, "process_page": 2, "ai_format": 3}

#: Monthly price and tokens of the plans. Fixed values.
PLANS = (("starter", 29, 1_000), ("pro", 79, 5_000), ("enterprise", 199, 20_000))

#: Time to live of a cache entry, seconds; entries of a full cache; entries that an eviction removes. Fixed values.
CACHE_TTL, CACHE_SIZE, CACHE_EVICTED = 86_400, 1_000, 100


def window_count(events: DataFrame, key: str, ts: str, seconds: int) -> Column:
    """Requests of a key in the window that ends with each event, itself included."""
    w = Window.partitionBy(key).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds + 1, 0)
    return F.count("*").over(w)


def keyed_scan(rows: DataFrame, key: str, order: list[str], start: Callable[[], State], step: Callable[[State, tuple], tuple[State, tuple]], out: str) -> DataFrame:
    """A sequential state over each key's rows in order; ``step`` takes the state and a row and gives the next state and a result row.

    Rows come sorted and in batches; a task holds one batch and the state of one
    key, however many rows the key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last, names = None, None, [c.split()[0] for c in out.split(", ")]
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False, name=None):
                if last is None or row[0] != last[0]:
                    state, last = start(), (row[0],)
                state, result = step(state, row)
                found.append(result)
            yield pd.DataFrame(found, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, out)


def admit(events: DataFrame, most: int, seconds: int, key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """Sliding-window admission: a denied request does not count against later ones.

    Whether a request counts depends on the decisions before it, so each key is
    a small sequential state: the admitted requests of the last window.
    """

    def step(held: list[float], row: tuple) -> tuple[list[float], tuple]:
        user, event_id, t = row
        held = [x for x in held if x > t - seconds]
        allowed = len(held) < most
        if allowed:
            held.append(t)
        return held, (user, event_id, allowed, most - len(held), held[0] + seconds)

    rows = events.select(F.col(key).alias("key"), F.col(event).alias("event"), F.col(ts).cast("timestamp").cast("double").alias("t"))
    return keyed_scan(rows, "key", ["t", "event"], list, step, "user_id long, event_id long, allowed boolean, remaining long, reset_at double")


def cache_hits(requests: DataFrame, key: Column, ts: str, ttl: int = CACHE_TTL, refresh: bool = False) -> DataFrame:
    """Is each request a hit?  ``refresh``: a hit starts the time to live anew.

    With refresh a request hits if the one before it is near enough.  Without,
    an entry lives from the miss that wrote it, so the last miss is carried along
    the key's times.
    """
    rows = requests.withColumns({"cache_key": key, "t": F.col(ts).cast("timestamp").cast("long")})
    if refresh:
        before = F.lag("t").over(Window.partitionBy("cache_key").orderBy("t", "event_id"))
        return rows.withColumn("hit", F.coalesce(F.col("t") - before < ttl, F.lit(False)))

    def step(since: int | None, row: tuple) -> tuple[int, tuple]:
        name, event_id, t = row
        hit = since is not None and t - since < ttl
        return (since if hit else t), (name, event_id, hit)

    return keyed_scan(rows.select("cache_key", "event_id", "t"), "cache_key", ["t", "event_id"], lambda: None, step, "cache_key string, event_id long, hit boolean")


def evicted(entries: DataFrame, hits: str, order: str, size: int = CACHE_SIZE, share: int = CACHE_EVICTED) -> DataFrame:
    """Entries that a full cache drops: those with the fewest hits, oldest first."""
    n = entries.count()
    return entries.orderBy(F.col(hits), F.col(order)).limit(share if n >= size else 0)


def cost_of(event_type: Column) -> Column:
    """Tokens of the driver's event types."""
    return F.when(event_type == "view", COSTS["query"]).when(event_type == "signup", COSTS["upload"]).when(event_type == "click", COSTS["process_page"]).when(event_type == "error", COSTS["ai_format"]).otherwise(0)


def spend(operations: DataFrame, opening: int, key: str = "user_id") -> DataFrame:
    """Balances where an operation that costs too much is refused and costs nothing.

    A refusal leaves the balance for the next operation, so it is carried along
    the key's operations.
    """

    def step(balance: int, row: tuple) -> tuple[int, tuple]:
        user, event_id, _, cost = row
        ok = cost <= balance
        balance -= cost if ok else 0
        return balance, (user, event_id, ok, balance)

    rows = operations.select(key, "event_id", "t", "cost")
    return keyed_scan(rows, key, ["t", "event_id"], lambda: opening, step, f"{key} long, event_id long, accepted boolean, balance long")
