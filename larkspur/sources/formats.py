"""Reading and writing tables in the file formats that Spark has built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "xml")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "error") -> None:
    """Write ``df``; CSV gets a header, XML a row tag, and JSON keeps null fields."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    w = df.write.format(fmt).mode(mode)
    w = w.options(**{"csv": {"header": True}, "json": {"ignoreNullFields": False}, "xml": {"rowTag": "row"}}.get(fmt, {}))
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read what ``write_table`` wrote. Text formats need a schema to keep types exactly."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    r = spark.read.format(fmt).options(**{"csv": {"header": True}, "xml": {"rowTag": "row"}}.get(fmt, {}))
    return (r.schema(schema) if schema is not None else r).load(path)
