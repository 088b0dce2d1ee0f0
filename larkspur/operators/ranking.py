"""Ranks of a total order, its pages, and keys that are frequent, over tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.split_windows import RANGE_ROWS, ranged, within

_ALL = ["_all"]


def _numbered(df: DataFrame, on: str, ties: list[str], rank: str, number: str, rows: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """``df`` with rank and row number; with ``first`` and ``last``, only the ranges that hold some of these row numbers are dealt out and sorted."""
    placed = ranged(df.withColumn("_all", F.lit(0)), _ALL, on, rows)
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range, GRID at most
    starts = counts.select("_range", "_rows", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    if first is not None:
        starts = starts.where((F.col("_before") < last) & (F.col("_before") + F.col("_rows") >= first))
    dealt = placed.join(F.broadcast(starts.drop("_rows")), "_range").repartition("_range")
    start = F.col("_before")
    out = dealt.withColumn(number, start + F.row_number().over(within([], on, *ties))).withColumn(rank, start + F.rank().over(within([], on)))
    return out.select(*(f"`{c}`" for c in df.columns), rank, number)


def global_rank(df: DataFrame, on: str, ties: list[str], rank: str = "rank", number: str = "row_number", rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with its rank by ``on`` (equal values share one) and its row number by ``on`` and ``ties``, ascending, null values first.

    The rows are cut at quantiles of ``on``, each range is numbered by itself, and the counts of the ranges before it are added:
    no task sorts more than a range, whereas a window without keys sorts all rows in one. Equal values of ``on`` share a range.
    """
    return _numbered(df, on, ties, rank, number, rows)


def page(df: DataFrame, on: str, ties: list[str], number: int, size: int, rows: int = RANGE_ROWS) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows of the order, with their row numbers; ranges without any of them are counted but not sorted."""
    numbered = _numbered(df, on, ties, "rank", "row_number", rows, (number - 1) * size + 1, number * size)
    return numbered.where((F.col("row_number") > (number - 1) * size) & (F.col("row_number") <= number * size))


def summarise(frames: Iterator[pd.Series], most: int) -> tuple[pd.Series, int, int]:
    """Counters of at most ``most`` values, how much each may be short of the value's count, and how many values there were.

    Counters are merged frame by frame; where there are more than ``most``, the next largest is taken off all and what is left
    of none goes. So a value with more than 1 in ``most + 1`` of the values has a counter.
    """
    held, short, total = pd.Series(dtype="int64"), 0, 0
    for f in frames:
        total += len(f)
        held = held.add(f.value_counts(), fill_value=0).astype("int64")
        if len(held) > most:
            off = int(held.nlargest(most + 1).iloc[-1])
            held, short = held[held > off] - off, short + off
    return held, short, total


def heavy_hitters(df: DataFrame, key: str, share: float, counters: int | None = None) -> DataFrame:
    """key, n: the values that make up at least ``share`` of all non-null ones, with their exact counts.

    Each task keeps a summary of ``counters`` values (2 / share by default), so its memory has a bound. A value with the share overall has it in some task;
    the candidates of all tasks, 1 / share a task at most, are counted exactly, by sums made before the shuffle.
    """
    if not 0 < share <= 1:
        raise ValueError("a share lies above 0 and not above 1")
    most = counters or int(2 / share) + 1
    if most < 1 / share:
        raise ValueError(f"{most} counters can miss a value of a share of {share}")
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k")).where("k IS NOT NULL")

    def run(frames):
        held, short, total = summarise((f["k"] for f in frames), most)
        some = held[held + short >= share * total]
        yield pd.DataFrame({"k": some.index.astype(object) if kind == "string" else some.index, "total": total})

    found = rows.mapInPandas(run, f"k {kind}, total long").select("k").distinct()
    counted = rows.join(found, "k", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    everything = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counted.where(F.col("n") >= F.lit(share) * everything).select(F.col("k").alias(key), "n")
