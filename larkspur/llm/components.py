"""Connected components of a graph too large for one machine, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import staged, unstage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (a, b: long), comp being its component's smallest node.

    Alternates the two star operations of the map-reduce algorithm (large-star, small-star): each round
    hooks neighbours to the smallest one known, and every round's edges are written to the shared folder,
    so lineage stays short. Rounds grow with the logarithm of the diameter. Loops, repeated edges and
    null ends are ignored; no edges give no rows. The driver sees two numbers a round. A graph that needs more
    than ``max_rounds`` rounds raises an error: there is no partial result.
    """
    now = staged(_clean(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "cc-edges")
    seen = _print(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _clean(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, now = now, staged(_clean(small), "cc-edges")
        was, seen = seen, _print(now)
        unstage(before)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).unionByName(tops)


def _clean(e: DataFrame) -> DataFrame:
    return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _print(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
