"""Tables written by buckets of a key and sorted in them, so that later joins and groupings by that key need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from larkspur.sources.scratch import shared_dir


#: Rows of a bucket at most, about.
BUCKET_ROWS = 1_000_000


def bucket_count(df: DataFrame, least: int, rows: int = BUCKET_ROWS) -> int:
    """Buckets for ``df``: one for every ``rows`` rows, and ``least`` at least, so that a task that sorts or groups a bucket needs no more memory for a longer table.

    Of two tables that are to be joined, the longer one says how many.
    """
    return max(least, -(-df.count() // rows))


def write_bucketed(df: DataFrame, keys: list[str], buckets: int, name: str = "bucketed") -> DataFrame:
    """Write ``df`` to the shared folder in ``buckets`` buckets by ``keys``, sorted by them, and return the table.

    One shuffle at writing makes one file a bucket. Two tables with equally many buckets by keys of one type are joined bucket with bucket.
    The catalog of the session knows the table under a name of its own; its files stay until the folder is cleaned.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)


def exchanges(df: DataFrame) -> int:
    """How many exchanges the plan of ``df`` has."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
