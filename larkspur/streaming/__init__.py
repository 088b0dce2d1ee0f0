"""Event streams from files: windowed counts, sessions, interval joins and custom state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.streaming.inactivity import inactivity, rocksdb
from larkspur.streaming.keyed_table import KeyedTable, forget_last_commit, run_to_keyed_table

__all__ = [
    "EVENTS", "KeyedTable", "first_of_key", "forget_last_commit", "inactivity", "interval_join", "read_events", "replay", "rocksdb",
    "run_to_files", "run_to_keyed_table", "run_to_memory", "running_totals", "session_counts", "window_counts",
]

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = 1, delay: str = "1 hour") -> DataFrame:
    """A stream of event files with a watermark. ``ts`` becomes a zoned timestamp, which watermarks need.

    Files come in the order in which they were written; with several triggers, rows older than what the watermark has passed
    are late and are dropped by windowed operators, so files should then follow event time. Without ``files_per_trigger`` all files make one trigger.
    """
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def window_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and sum per window and event type; in append mode a window comes once the watermark has passed it."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def interval_join(left: DataFrame, right: DataFrame, within: str = "1 hour") -> DataFrame:
    """Pairs of one user whose right event comes at or after the left one, within a time; both sides need watermarks."""
    a = left.select(F.col("user_id").alias("user_id"), F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts"))
    b = right.select(F.col("user_id").alias("u"), F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts"))
    return a.join(b, F.expr(f"user_id = u AND right_ts >= left_ts AND right_ts <= left_ts + INTERVAL {within}")).drop("u")


def first_of_key(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once while the watermark remembers it."""
    return events.dropDuplicatesWithinWatermark([key])


def running_totals(events: DataFrame) -> DataFrame:
    """Per user and batch the events and value so far, by custom state: user_id, n, total."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_to_files(stream: DataFrame, path: str) -> DataFrame:
    """Process all files that are there in append mode, to Parquet files below ``path``, and return what they hold."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process all files that are there and return the sink's table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def replay(events: DataFrame, folder: str, run: Callable[[], object], parts: int = 4, ts: str = "ts") -> None:
    """Let a table come as a stream: its rows arrive in ``folder`` in ``parts`` parts by time, and ``run`` is called after each, so that a stream's query stops and goes on from its checkpoint."""
    at = F.col(ts).cast("timestamp")
    bounds = events.select(F.percentile_approx(F.unix_micros(at), [k / parts for k in range(1, parts)], 10_000).alias("b")).first().b or []
    part = F.array_size(F.filter(F.array(*(F.lit(b) for b in bounds)).cast("array<long>"), lambda b: b <= F.unix_micros(at)))
    for k in range(len(bounds) + 1):
        events.where(F.coalesce(part, F.lit(0)) == k).write.mode("append").parquet(folder)
        run()
