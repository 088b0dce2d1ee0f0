"""Python functions beside Spark's own: scalar, aggregate and table functions, all by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


@F.pandas_udf(StringType())
def reversed_words(texts: pd.Series) -> pd.Series:
    """The words of each text in reverse order; null stays null."""
    return texts.map(lambda t: None if t is None else " ".join(reversed(t.split(" "))))


def aggregate(df: DataFrame, keys: list[str], partial: Callable[[pd.DataFrame], pd.DataFrame], schema: str, merge: dict[str, Column]) -> DataFrame:
    """A user-defined aggregate in two steps: ``partial`` makes rows of state from any rows, ``merge`` combines states by built-in aggregates.

    ``partial`` sees one batch at a time and returns keys and state as in ``schema``, so a group's rows are never
    together in one task and only states are shuffled.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield partial(f)

    return df.mapInPandas(run, schema).groupBy(*keys).agg(*(c.alias(n) for n, c in merge.items()))


@F.udtf(returnType=StructType([StructField("place", IntegerType()), StructField("word", StringType())]), useArrow=True)
class Words:
    """The words of a text and their places from 1; no rows for null."""

    def eval(self, text: str):
        for i, w in enumerate(text.split(" ") if text is not None else (), 1):
            yield i, w
