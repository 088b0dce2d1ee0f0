"""Windows over keys of any size: a key's rows are cut into ranges of their order, and what a range needs to know of those before it is scanned.

A window function sorts all rows of a key in one task. Here a key of many rows is cut at quantiles of its own order, each range is
folded to a state (its last value, its sum, its first and last session), the states of a key, one a range, are scanned in order, and each
range's rows are windowed on their own and joined with what the scan says came before. Rows are shuffled once, by
key and range; keys of few rows are one range and take no part in the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larkspur.operators.quantiles import position

#: Rows of a key from which on it is cut, and rows of a range, about.
RANGE_ROWS = 100_000
#: Ranges of one key at most, a power of two; more rows make longer ranges.
GRID = 1024


def same(left: DataFrame, right: DataFrame, by: list[str], extra: tuple[str, ...] = (), how: str = "left") -> DataFrame:
    """A join on ``by``, null keys too, and on ``extra``; the columns of ``right`` that it is not joined on are added.

    ``right`` has one row for some ``rows`` rows of ``left`` at most and is broadcast: ``left`` is not shuffled, and a key that is the same
    in all rows, whose test the optimizer drops, doesn't make it the side that is broadcast.
    """
    named = right.select(*(F.col(f"`{c}`").alias(f"_r{i}") if c in (*by, *extra) else F.col(f"`{c}`") for i, c in enumerate(right.columns)))
    place = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    on = reduce(lambda a, b: a & b, (left[f"`{c}`"].eqNullSafe(named[place[c]]) for c in (*by, *extra)))
    return left.join(F.broadcast(named), on, how).drop(*(place[c] for c in (*by, *extra)))


def ranged(df: DataFrame, by: list[str], on: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``_range``: 0 where the key has at most ``rows`` rows, else 1, 2, ... along ``on`` (a number, date or timestamp).

    Equal values of ``on`` share a range, so rows of one key and one value stay together. Null values come first. The keys
    that are cut are at most one in ``rows`` rows; each has GRID quantiles at most.
    """
    many = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    if many.isEmpty():
        return df.withColumn("_range", F.lit(0))
    grid = F.percentile_approx(on, [i / GRID for i in range(GRID)], 10 * GRID)
    cut = same(df.select(*by, on), many, by, how="inner").groupBy(*by).agg(grid.alias("_grid"), F.first("_n").alias("_n"))
    ranges = F.least(F.lit(GRID), F.ceil(F.col("_n") / rows)).cast("int")
    bounds = F.transform(F.sequence(F.lit(1), ranges - 1), lambda i: F.get(F.col("_grid"), F.floor(i * GRID / ranges).cast("int")))
    placed = same(df, cut.select(*by, bounds.alias("_bounds")), by)
    return placed.withColumn("_range", F.when(F.col("_bounds").isNull(), 0).otherwise(position(F.col("_bounds"), F.col(on), GRID) + 1)).drop("_bounds")


def before(df: DataFrame, by: list[str], state: dict[str, Column], scan: dict[str, Column]) -> DataFrame:
    """``df`` (from ``ranged``) with what its ranges' predecessors leave: ``state`` folds a range, ``scan`` is windowed over the states of earlier ranges.

    The names of ``scan`` are added, null for the first range of a key and for keys that are not cut.
    """
    folded = df.where("_range > 0").groupBy(*by, "_range").agg(*(c.alias(n) for n, c in state.items()))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = same(df, folded.select(*by, "_range", *(c.over(earlier).alias(n) for n, c in scan.items())), by, ("_range",))
    return carried.repartition(*by, "_range")


def within(by: list[str], *order) -> WindowSpec:
    """A key's range, in order."""
    return Window.partitionBy(*by, "_range").orderBy(*order)


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "running", rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the sum of ``value`` over its key's rows up to and with each one, in ``order``; the first of ``order`` makes the ranges.

    Nulls add nothing; before the first value the sum is null. ``order`` should be total: rows that tie are summed in any order.
    """
    own = F.sum(value).over(within(by, *order).rowsBetween(Window.unboundedPreceding, 0))
    carried = before(ranged(df, by, order[0], rows), by, {"_sum": F.sum(value)}, {"_before": F.sum("_sum")})
    total = F.when(F.col("_before").isNull(), own).otherwise(F.col("_before") + F.coalesce(own, F.lit(0)))
    return carried.withColumn(name, total).drop("_range", "_before")


def fill_forward(df: DataFrame, key: str, ts: str, value: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``value`` with nulls replaced by the last value before them in the key's time order; null times come first."""
    known = F.struct(F.col(ts).alias("t"))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), known))
    carried = before(ranged(df, [key], ts, rows), [key], {"_last": last}, {"_before": F.last("_last", ignorenulls=True)})
    own = F.last(value, ignorenulls=True).over(within([key], ts).rowsBetween(Window.unboundedPreceding, 0))
    return carried.withColumn(value, F.coalesce(own, "_before")).select(*(f"`{c}`" for c in df.columns))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` at or before its ``on``, per key ``by``.

    Both sides are stacked and sorted once per key and range, and the last right row is carried along, so no pair is
    ever made that isn't in the result. Ties on the right go to the largest ``take``. Left rows without a
    match have nulls; null keys match each other as one key. Null times match right rows with null times only.
    """
    carried = F.struct(*(F.col(c) for c in take))
    names = left.columns
    a = left.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), *by, F.col(on).alias("_on"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(carried.alias("s")).schema[0].dataType).alias("_take"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *by, F.col(on).alias("_on"), F.lit(0).alias("_side"), carried.alias("_take"))
    last = F.max_by("_take", F.when(F.col("_side") == 0, F.struct("_on", "_take")))
    placed = before(ranged(a.unionByName(b), by, "_on", rows), by, {"_latest": last}, {"_before": F.last("_latest", ignorenulls=True)})
    own = F.last("_take", ignorenulls=True).over(within(by, "_on", "_side", "_take").rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("_last", F.coalesce(own, "_before")).where("_side = 1")
    return out.select("_row.*", *(F.col("_last")[c].alias(f"asof_{c}") for c in take))


def sessions(events: DataFrame, gap_seconds: int, key: str, ts: str = "ts", rows: int = RANGE_ROWS) -> DataFrame:
    """key, session_start, session_end (last event), n_events; a session ends when the next event is ``gap_seconds`` or more away.

    Sessions are made within ranges first. Only the first and the last one of a range can go on beyond it: a scan over the ranges finds
    which of them are one, and those are added up; all others are final.
    """
    by = [key]
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    far = lambda at, last: F.coalesce(micros(at) - micros(last) >= gap_seconds * 1_000_000, F.lit(True))
    placed = ranged(events.select(key, ts), by, ts, rows).repartition(*by, "_range")
    w = within(by, ts)
    numbered = placed.withColumn("_s", F.sum(far(F.col(ts), F.lag(ts).over(w)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(key, "_range", "_s").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("n_events"))
    final = ["session_start", "session_end", "n_events"]
    done = parts.where("_range = 0").select(key, *final)
    # of each range: how many sessions, where the first begins, where the last ends
    ends = parts.where("_range > 0").groupBy(key, "_range").agg(F.max("_s").alias("_most"), F.min("session_start").alias("_first"), F.max("session_end").alias("_last"))
    order = Window.partitionBy(key).orderBy("_range")
    ends = ends.withColumn("_new", far(F.col("_first"), F.lag("_last").over(order)))
    # the session that is open at a range's end has a number, which grows where another one is open than at the end before
    ends = ends.withColumn("_open", F.sum((F.col("_new") | (F.col("_most") > 1)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_was", F.lag("_open").over(order)).select(key, "_range", "_most", "_new", "_open", "_was")
    edge = same(parts.where("_range > 0"), ends, by, ("_range",))
    joined = F.when((F.col("_s") == 1) & ~F.col("_new"), F.col("_was")).when(F.col("_s") == F.col("_most"), F.col("_open"))
    edge = edge.withColumn("_open", joined)
    whole = edge.where("_open IS NULL").select(key, *final)
    merged = edge.where("_open IS NOT NULL").groupBy(key, "_open").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("n_events").alias("n_events"))
    return done.unionByName(whole).unionByName(merged.select(key, *final))
