"""Time-series operators over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame, every: str, keys: list[str], aggs: dict[str, Column], ts: str = "ts") -> DataFrame:
    """Tumbling windows: bucket start, keys and aggregates. One partial aggregation, one shuffle."""
    return events.groupBy(F.window(ts, every)["start"].alias("bucket"), *keys).agg(*(c.alias(n) for n, c in aggs.items()))


def funnel(events: DataFrame, steps: list[str], key: str, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """key and how many of ``steps`` it passed in order, each at a time strictly after the one before.

    The earliest time of each step after the one before is a minimum that combines before it is shuffled, so a
    key of very many events is no group anywhere. Keys without any of the steps have no row; one whose first
    event is another step has depth 0. Null times pass nothing.
    """
    out = events.where(F.col(kind).isin(steps)).select(key).distinct().withColumn("depth", F.lit(0))
    before = None
    for n, step in enumerate(steps, 1):
        own = events.where(F.col(kind) == step).select(F.col(key).alias("_k"), F.col(ts).alias("_t"))
        if before is not None:
            own = own.join(before, "_k").where("_t > _before")
        before = own.groupBy("_k").agg(F.min("_t").alias("_before")).where("_before IS NOT NULL")
        out = out.join(before.select(F.col("_k").alias(key), F.lit(n).alias("_n")), key, "left").select(key, F.coalesce("_n", "depth").alias("depth"))
    return out
