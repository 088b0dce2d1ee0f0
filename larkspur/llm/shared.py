"""What the corpus operators share: staged tables in the cluster's shared folder, and whole-text byte views."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.scratch import scratch, shared_dir

__all__ = ["SPACE", "WORD", "documents", "shared_dir", "staged", "text_or_empty", "unstage"]

#: White space between words, and the words themselves, as the operators count them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later jobs read the files, so a lost executor costs only the tasks it was running,
    and values that depend on how rows met in a task are fixed from here on.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` wrote; for those that no DataFrame still to be run reads."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
