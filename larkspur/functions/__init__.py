"""Column functions that Spark lacks under one name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays of numbers; null where a norm is zero or an array is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
