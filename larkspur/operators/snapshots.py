"""What has changed between two snapshots of a table, reading only the ranges of keys in which something has."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.quantiles import position

#: Ranges of keys of a snapshot, a power of two, and children of a node of its tree.
RANGES, FAN = 256, 16


def _digest(columns: list[str]) -> list[Column]:
    """Rows, and sums of two hashes of the rows: equal for equal bags of rows, in any order."""
    cols = [F.col(f"`{c}`") for c in columns]
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("n"), wide(F.xxhash64(*cols)).alias("h1"), wide(F.xxhash64(F.lit("again"), *cols)).alias("h2")]


def _about(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/about").first()[0])


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a snapshot and their range."""
    schema = T.StructType.fromJson(json.loads(_about(spark, path)["schema"]))
    return spark.read.schema(schema.add("_range", T.IntegerType())).parquet(f"{path}/rows")


def write_snapshot(df: DataFrame, path: str, key: str, like: str | None = None, ranges: int = RANGES) -> None:
    """Write ``df`` by ranges of ``key`` (a number), with a digest of each range.

    Ranges are quantiles of this table's keys, or those of the snapshot ``like``, so that the two can be compared. A null key
    is in the first range.
    """
    spark = df.sparkSession
    if like:
        bounds = _about(spark, like)["bounds"]
    else:
        bounds = sorted(set(df.select(F.percentile_approx(F.col(key).cast("double"), [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []))
    spark.createDataFrame([(json.dumps({"bounds": bounds, "schema": df.schema.json()}),)], "value string").coalesce(1).write.text(f"{path}/about")
    at = position(F.array(*(F.lit(b) for b in bounds)).cast("array<double>"), F.col(key).cast("double"), ranges)
    df.withColumn("_range", at).repartition("_range").write.partitionBy("_range").parquet(f"{path}/rows")
    _rows(spark, path).groupBy("_range").agg(*_digest(df.columns)).coalesce(1).write.parquet(f"{path}/digests")


def _leaves(spark: SparkSession, path: str) -> dict[int, tuple]:
    """A digest for each range that has rows: RANGES at most."""
    return {r["_range"]: (r.n, r.h1, r.h2) for r in spark.read.parquet(f"{path}/digests").collect()}


def differing(old: dict[int, tuple], new: dict[int, tuple], ranges: int = RANGES) -> tuple[list[int], int]:
    """The ranges whose digests differ, found from the root of the tree of sums down, and how many nodes were looked at."""
    levels = [(old, new)]
    while ranges > 1:
        up = []
        for leaves in levels[-1]:
            sums: dict[int, tuple] = {}
            for r, d in leaves.items():
                sums[r // FAN] = tuple(a + b for a, b in zip(sums.get(r // FAN, (0, 0, 0)), d))
            up.append(sums)
        levels.append(tuple(up))
        ranges = -(-ranges // FAN)
    nodes, seen = [0], 0
    for depth, (a, b) in enumerate(reversed(levels)):
        nodes = [n for n in nodes if n in a or n in b]
        seen += len(nodes)
        nodes = [n for n in nodes if a.get(n) != b.get(n)]
        if depth < len(levels) - 1:
            nodes = [n * FAN + k for n in nodes for k in range(FAN)]
    return nodes, seen


def snapshot_difference(spark: SparkSession, old: str, new: str, key: str) -> DataFrame:
    """key and change: inserted, deleted or changed.

    The tree of digests says in which ranges of keys the snapshots differ; rows are read of those alone. Rows that share a key are one bag,
    which is changed if any row of it is; null keys are one key. The driver sees digests, one for each range.
    """
    if _about(spark, old)["bounds"] != _about(spark, new)["bounds"]:
        raise ValueError("the snapshots have different ranges of keys")
    ranges, _ = differing(_leaves(spark, old), _leaves(spark, new))
    bags = []
    for path, side in ((old, "old"), (new, "new")):
        rows = _rows(spark, path)
        columns = [c for c in rows.columns if c != "_range"]
        rows = rows.where(F.col("_range").isin(ranges) if ranges else F.lit(False))
        bags.append(rows.groupBy(F.col(f"`{key}`").alias(f"{side}_key")).agg(F.struct(*_digest(columns)).alias(side)))
    both = bags[0].join(bags[1], F.col("old_key").eqNullSafe(F.col("new_key")), "full")
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.select(F.when(F.col("old").isNull(), F.col("new_key")).otherwise(F.col("old_key")).alias(key), change.alias("change")).where("change IS NOT NULL")
