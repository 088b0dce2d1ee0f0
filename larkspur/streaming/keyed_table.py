"""A table with one row a key, brought up to date by the micro-batches of a stream; replayed batches change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """Rows by hash of their key in ``buckets`` buckets, each a Parquet folder of the batch that wrote it last.

    ``path/data/batch=N/_bucket=B`` holds bucket B as of batch N, ``path/log/batch=N`` says which buckets batch N wrote. A batch
    rewrites the buckets it touches, and its log entry, written last, is its commit: a batch whose entry is complete is passed over,
    one that broke off is written anew over what it left. Of rows with one key the last by ``order`` stays, of equals
    the largest row; a null key is a key.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 16) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def _exists(self, *parts: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self, batch: int) -> bool:
        return self._exists("log", f"batch={batch}", "_SUCCESS")

    def versions(self) -> dict[int, int]:
        """The batch that wrote each bucket last: one number a bucket."""
        if not self._exists("log"):
            return {}
        log = self.spark.read.schema("bucket int, written long").json(f"{self.path}/log/*")
        return {r.bucket: r.last for r in log.groupBy("bucket").agg(F.max("written").alias("last")).collect()}

    def _folders(self, versions: dict[int, int]) -> list[str]:
        return [f"{self.path}/data/batch={n}/_bucket={b}" for b, n in sorted(versions.items())]

    def read(self) -> DataFrame | None:
        """The rows as of the last commit; None before the first."""
        folders = self._folders(self.versions())
        return self.spark.read.parquet(*folders) if folders else None

    def _last(self, rows: DataFrame) -> DataFrame:
        names = rows.columns
        newest = F.max(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(self.order)), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")))
        return rows.groupBy(*self.keys).agg(newest.alias("newest")).select("newest.row.*")

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Bring the table up to date with a batch; for ``foreachBatch``."""
        if self.committed(batch):
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r.b for r in rows.select(bucket.alias("b")).distinct().collect())  # at most one for each bucket
        if touched:
            known = self.versions()
            before = self._folders({b: known[b] for b in touched if b in known})
            both = rows.unionByName(self.spark.read.schema(rows.schema).parquet(*before)) if before else rows
            out = self._last(both).withColumn("_bucket", bucket).repartition(len(touched), "_bucket")
            out.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/batch={batch}")
        entry = self.spark.createDataFrame([(b, batch) for b in touched], "bucket int, written long")
        entry.coalesce(1).write.mode("overwrite").json(f"{self.path}/log/batch={batch}")

    def vacuum(self) -> int:
        """Delete the folders of batches of which no bucket is current any more; how many."""
        used, gone = set(self.versions().values()), 0
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(top) if fs.exists(top) else []:
            if int(f.getPath().getName().removeprefix("batch=")) not in used:
                fs.delete(f.getPath(), True)
                gone += 1
        return gone


def run_to_keyed_table(stream: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """Process all files that are there into ``table``."""
    q = stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def forget_last_commit(spark: SparkSession, checkpoint: str) -> int:
    """Take back the stream's note that its last batch is done, as a crash between sink and note would; the batch's number, which comes again."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(int(f.getPath().getName()) for f in fs.listStatus(top) if f.getPath().getName().isdigit())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{last}"), False)
    return last
