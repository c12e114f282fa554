"""Event streams: sessions, windows, rate limits and conversation state.

The source's times have no zone; they are cast to timestamps before any
watermark.  State is keyed, bounded per key and dropped by timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The events below a folder as a stream, new files as they arrive."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events and value of each session; a session ends after a gap."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def windowed_counts(events: DataFrame, length: str = "1 day", slide: str = "12 hours", late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"))


def limited(events: DataFrame, most: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """Sliding-window admission with state: the admitted times of the last window, at most ``most`` per user."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            rows = []
            for event_id, ts in batch.sort_values(["ts", "event_id"])[["event_id", "ts"]].itertuples(index=False):
                t = ts.timestamp()
                held = [x for x in held if x > t - seconds]
                allowed = len(held) < most
                if allowed:
                    held.append(t)
                rows.append((key[0], event_id, allowed))
            yield pd.DataFrame(rows, columns=["user_id", "event_id", "allowed"])
        state.update((held,))
        if held:
            state.setTimeoutTimestamp(max(int((held[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    marked = events.withWatermark("ts", late)
    return marked.groupBy("user_id").applyInPandasWithState(decide, "user_id long, event_id long, allowed boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def ingest(landing: DataFrame, write, checkpoint: str):
    """Micro-batches of new files go through ``write(batch, epoch)``; the checkpoint is the queue."""
    return landing.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return the sink's rows."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
