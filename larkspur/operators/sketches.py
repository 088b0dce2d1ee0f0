"""Stored sketches that merge: counts, quantiles and distinct users per hour and key, rolled up and combined without reading rows again."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketch, and binary logarithms of the sizes of the distinct sketches.
K, LG_HLL, LG_THETA = 400, 12, 12
#: Standard errors that an estimate may be off.
SIGMAS = 4.0


def hll_error(lg: int = LG_HLL) -> float:
    """Relative error of a distinct count, SIGMAS standard errors."""
    return SIGMAS * 1.04 / sqrt(1 << lg)


def theta_error(lg: int = LG_THETA) -> float:
    return SIGMAS / sqrt(1 << lg)


def rank_error(k: int = K) -> float:
    """Error of a quantile's rank as a share of all rows, at 99 % for one quantile and its merges, doubled."""
    return 2 * 2.446 / k**0.9433


def sketch(rows: DataFrame, keys: list[str], distinct: str, value: str, every: str | None = None, ts: str = "ts") -> DataFrame:
    """A table to store: ``keys`` (and ``bucket``, with ``every``), n, and sketches ``quantiles`` of a number, ``hll`` and ``theta`` of a key.

    Sketches are built before the shuffle and merged after it, so a key of any size is one sketch a task. Nulls, and NaN in ``value``, are not
    counted; a group without any other value has empty sketches.
    """
    by = [*([F.window(ts, every)["start"].alias("bucket")] if every else []), *keys]
    number = F.col(value).cast("double")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.when(~F.isnan(number), number), F.lit(K)).alias("quantiles"),
        F.hll_sketch_agg(distinct, F.lit(LG_HLL)).alias("hll"), F.theta_sketch_agg(distinct, F.lit(LG_THETA)).alias("theta"))


def roll_up(stored: DataFrame, *by: Column | str) -> DataFrame:
    """The table at a coarser level, from its sketches alone; without ``by`` all of it."""
    return stored.groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta").alias("theta"))


def quantile(p: float, of: str = "quantiles") -> Column:
    """An estimate of a quantile; see ``rank_error``. Null where no value was counted."""
    return F.when(F.kll_sketch_get_n_double(of) > 0, F.kll_sketch_get_quantile_double(F.col(of), F.lit(float(p))))


def rank(value: Column, of: str = "quantiles") -> Column:
    """An estimate of the share of values at or below one; null where no value was counted."""
    return F.when(F.kll_sketch_get_n_double(of) > 0, F.kll_sketch_get_rank_double(F.col(of), value))


def n_distinct(of: str = "hll") -> Column:
    return F.coalesce(F.hll_sketch_estimate(of), F.lit(0))


def n_both(a: str, b: str) -> Column:
    """How many keys two theta sketches share."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def n_only(a: str, b: str) -> Column:
    """How many keys the first theta sketch has and the second has not."""
    return F.theta_sketch_estimate(F.theta_difference(a, b))


def n_either(a: str, b: str) -> Column:
    return F.theta_sketch_estimate(F.theta_union(a, b, F.lit(LG_THETA)))


def within(estimate: Column, exact: Column, error: float, of: Column | None = None) -> Column:
    """Whether an estimate is within ``error`` times ``of`` (the exact value, if absent) of the exact value."""
    return F.abs(estimate - exact) <= error * (exact if of is None else of) + 0.5

