"""Joins that Spark's DataFrame API has no single call for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, lo: float, hi: float, width: float | None = None) -> DataFrame:
    """Pairs with ``left_on + lo <= right_on <= left_on + hi``, as an equi-join on bins of the value.

    The left side is repeated once for each bin its band touches, so the join hashes and never compares
    all pairs. ``width`` defaults to the band's own width. Nulls match nothing. The ends of the band are rounded sums, as in
    SQL's ``BETWEEN``, and the bins are made from these; a difference ``right_on - left_on`` would be rounded otherwise.
    """
    width = float(width or max(hi - lo, 1e-9))
    bins = F.sequence(F.floor((F.col(left_on) + lo) / width), F.floor((F.col(left_on) + hi) / width))
    a = left.where(F.col(left_on).isNotNull()).withColumn("_bin", F.explode(bins))
    b = right.where(F.col(right_on).isNotNull()).withColumn("_bin", F.floor(F.col(right_on) / width))
    inside = F.col(right_on).between(F.col(left_on) + lo, F.col(left_on) + hi)
    return a.join(b, "_bin").where(inside).drop("_bin")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are dealt over ``salts`` tasks: left rows get a salt by their content, right rows all of them."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join keeps the left side whole; {how!r} does not")
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [key, "_salt"], how).drop("_salt")
