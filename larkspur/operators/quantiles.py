"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which the values of a group are counted first, a power of two.
BINS = 1024
#: Groups up to which what is known of them is broadcast.
FEW = 10_000


def position(bounds: Column, value: Column, most: int) -> Column:
    """How many of a sorted array of up to ``2 * most - 1`` bounds are at or below a value, by halving steps; ``most`` is a power of two."""
    steps = F.array(*(F.lit(most >> k) for k in range(most.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))


def binned(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """``rows`` (_k, _v) with ``_b``: ranges of about equally many values, from a quantile sketch of each group.

    However the values lie, a range has about 1 in ``bins`` of its group's values, but for copies of one value.
    """
    grid = F.percentile_approx("_v", [i / bins for i in range(1, bins)], 10 * bins)
    bounds = rows.where("_v IS NOT NULL").groupBy("_k").agg(F.array_distinct(grid).alias("_bounds"))
    return _with(rows.where("_v IS NOT NULL"), bounds).select("_k", "_v", position(F.col("_bounds"), F.col("_v"), bins).alias("_b"))


def around(rows: DataFrame, at: list[float], bins: int = BINS, few: bool = True) -> DataFrame:
    """``rows`` (_k, _v) with ``_b``: an even range between values just below and above each quantile in ``at``, an odd one for each of these values themselves.

    The values come from a quantile sketch and are two of its errors away from the quantile, so the range of a wanted rank
    has about 4 in ``10 * bins`` of its group's values, or copies of one value; where the sketch errs it has more, but none is lost.
    """
    near = sorted({min(1.0, max(0.0, p + off / (10 * bins))) for p in at for off in (-2, 2)})
    own = rows.where("_v IS NOT NULL")
    bounds = own.groupBy("_k").agg(F.array_distinct(F.percentile_approx("_v", near, 10 * bins)).alias("_bounds"))
    both = _with(own, bounds, few=few)
    if len(near) <= 16:  # compiled, unlike the steps of ``position``
        said = (F.coalesce(test.cast("int"), F.lit(0)) for i in range(len(near)) for b in [F.get("_bounds", F.lit(i))] for test in (b <= F.col("_v"), b < F.col("_v")))
        return both.select("_k", "_v", sum(said, F.lit(0)).alias("_b"))
    at_or_below = both.select("*", position(F.col("_bounds"), F.col("_v"), 1 << len(near).bit_length() - 1).alias("_p"))
    on_it = F.coalesce((F.get("_bounds", F.col("_p") - 1) == F.col("_v")).cast("int"), F.lit(0))
    return at_or_below.select("_k", "_v", (2 * F.col("_p") - on_it).alias("_b"))


def quantiles(df: DataFrame, key: str, value: str, at: dict[str, float], bins: int = BINS) -> DataFrame:
    """key and, for each name in ``at``, the exact quantile of ``value`` (interpolated between neighbours).

    No task holds a group: its values are counted in ranges whose bounds, close to the quantiles, come from a sketch of accuracy ``10 * bins``,
    only the ranges that hold a wanted rank are looked at again, and there equal values are counted once. The sketch places bounds; it does not
    decide results. With FEW groups the rows themselves are not shuffled. Nulls and NaN don't count; a group of nulls alone has null quantiles.
    """
    rows = df.select(F.col(key).alias("_k"), F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("_v"))
    few = rows.select("_k").distinct().limit(FEW + 1).count() <= FEW
    span = rows.groupBy("_k").agg(F.count("_v").alias("_n"))
    placed = around(rows, list(at.values()), bins, few)
    upto = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_k", "_b").agg(F.count("_v").alias("_c")).withColumn("_from", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    # the two ranks (from 0) beside each quantile, and the range that holds them
    wanted = F.array(*(F.struct(F.lit(name).alias("_q"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_r")) for name, p in at.items()))
    wanted = span.where("_n > 0").select("_k", F.inline(wanted))
    ranks = wanted.select("_k", "_q", "_r", F.explode(F.array_distinct(F.array(F.floor("_r"), F.ceil("_r")))).alias("_rank"))
    held = _with(ranks, counts, (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_c")))
    some = held.select("_k", F.col("_b").alias("_b2")).distinct()
    inside = Window.partitionBy("_k", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    values = _with(placed, some, F.col("_b") == F.col("_b2"), few=few).groupBy("_k", "_b", "_v").agg(F.count(F.lit(1)).alias("_m"))
    values = values.select("_k", F.col("_b").alias("_b2"), "_v", "_m", F.coalesce(F.sum("_m").over(inside), F.lit(0)).alias("_at"))
    rank = F.col("_rank") - F.col("_from")
    hit = _with(held, values, (F.col("_b") == F.col("_b2")) & (rank >= F.col("_at")) & (rank < F.col("_at") + F.col("_m")))
    near = hit.groupBy("_k", "_q").agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"), F.max("_r").alias("_r"))
    said = near.select("_k", "_q", (F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_r") - F.floor("_r"))).alias("_x"))
    wide = said.groupBy("_k").agg(*(F.max(F.when(F.col("_q") == name, F.col("_x"))).alias(name) for name in at))
    return _with(span.select("_k"), wide, how="left").select(F.col("_k").alias(key), *at)


def _with(left: DataFrame, right: DataFrame, on: Column | None = None, how: str = "inner", few: bool = False) -> DataFrame:
    """A join on ``_k``, null keys too; with ``few``, ``right`` is broadcast, else all rows of a key would meet in one task."""
    same = F.col("_k").eqNullSafe(F.col("_k2"))
    other = right.withColumnRenamed("_k", "_k2")
    return left.join(F.broadcast(other) if few else other, same if on is None else same & on, how).drop("_k2")
