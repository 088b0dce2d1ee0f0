"""Nearest vectors by cosine, every query against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a group, about, rows they are multiplied with at a time, and queries multiplied at a time (2 MB of products).
QUERY_BLOCK, ROW_BLOCK, STEP = 4096, 1024, 256
#: Rows of a deal, about: a task gets them in one Arrow batch.
DEAL_ROWS = 50_000
#: Similarities are compared as whole numbers of 1e-5; this one stands for null and sorts last.
SCALE = 100_000
NONE = -2 * SCALE


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as doubles, and their norms; the norm of a null or zero vector is NaN."""
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    n = int(there.sum())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = np.zeros((len(vectors), len(flat) // n if n else 0))
    m[there] = flat.reshape(n, -1) if n else 0.0
    norm = np.sqrt((m * m).sum(1))
    norm[norm == 0] = np.nan
    return m, norm


def _first(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of each row, by similarity from the largest, then id."""
    order = np.lexsort((ids, -sims))[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _column(t: pa.Table, j: int) -> pa.Array:
    """A column in one piece."""
    c = t.column(j).combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


class _Block:
    """Some queries: ids, groups, vectors and norms."""

    def __init__(self, rows: pa.Table) -> None:
        self.ids, self.groups = (_column(rows, j).to_numpy() for j in (0, 1))
        self.vectors, self.norms = _matrix(_column(rows, 2))

    def nearest(self, ids: np.ndarray, groups: np.ndarray, vectors: np.ndarray, norms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the ``k`` nearest of some rows for each query; places that no row takes have similarity NONE - 1."""
        order = np.argsort(ids, kind="stable")
        rows = ids[order], groups[order], vectors[order], norms[order]
        parts = [self._some(slice(at, at + STEP), *rows, k) for at in range(0, len(self.ids), STEP)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _some(self, own: slice, ids: np.ndarray, groups: np.ndarray, vectors: np.ndarray, norms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for some of the queries, and rows by id."""
        n = len(ids)
        asked, asked_ids = self.vectors[own], self.ids[own]
        # a null has no length, so a side of nulls alone fits any other
        dot = asked @ vectors.T if asked.shape[1] == vectors.shape[1] else np.full((len(asked), n), np.nan)
        x = dot / (self.norms[own, None] * norms) * SCALE
        sims = np.where(np.isnan(x), NONE, np.copysign(np.floor(np.abs(x) + 0.5), x)).astype(np.int64)
        # one number for similarity and place, so that equal similarities keep the smaller ids
        key = (sims - NONE + 1) * n + np.arange(n - 1, -1, -1)
        key[(asked_ids[:, None] == ids) | (self.groups[own, None] != groups)] = -1
        if n > k:
            key = np.partition(key, n - k, axis=1)[:, n - k :]
        return np.where(key < 0, np.iinfo(np.int64).max, ids[n - 1 - key % n]), np.where(key < 0, NONE - 1, key // n + NONE - 1)


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(number, some rows of (i, g, v) as Arrow bytes), of up to ``size`` rows each; the number counts a task's blocks."""
    held: list = []
    n = count = 0

    def done():
        t = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n", "blob"])

    for b in batches:
        for lo in range(0, b.num_rows, size):
            held.append(b.slice(lo, size))
            count += held[-1].num_rows
            if count >= size:
                yield done()
                held, count, n = [], 0, n + 1
    if count:
        yield done()


def _unpacked(blob: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", within: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` rows nearest to each query: ``id_col``, other, sim (cosine, five decimals), without rows of the query's own id.

    Queries and rows are packed into blocks. Every query block meets every block of rows: queries are dealt out in about
    ``block`` a group, rows in as many deals as fill the tasks, of DEAL_ROWS at most, about, and a task multiplies a group with a deal's blocks one after the other,
    keeping the ``k`` best a query; those of all deals are merged. No vector passes the driver. Equal similarities go to the smaller id. With
    ``within``, an integer column, only rows of the query's own value count, without a join on it. Null vectors and zero norms
    have null similarity, which is last; null ids, and null values of ``within``, match nothing. Vectors have one length.
    """
    group = F.col(within).cast("long") if within else F.lit(0).cast("long")
    some = lambda df: df.select(F.col(id_col).cast("long").alias("i"), group.alias("g"), F.col(vector_col).cast("array<double>").alias("v")).where("i IS NOT NULL AND g IS NOT NULL")
    asked, every = some(queries), some(rows)
    groups = max(1, -(-asked.count() // block))
    deals = max(1, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups), -(-rows.count() // DEAL_ROWS))

    def pack(size):
        return lambda batches: _packed(batches, size)

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = asked.withColumn("q", F.pmod(F.xxhash64("i"), F.lit(groups)).cast("int")).repartition(groups, "q").sortWithinPartitions("q")

    def pack_groups(batches):
        """Blocks of one group each."""
        for b in batches:
            q = b.column(3).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), len(q)] if len(q) else [0]
            for lo, hi in zip(cut[:-1], cut[1:]):
                for x in _packed(iter([b.slice(lo, hi - lo).select([0, 1, 2])]), hi - lo):
                    yield pa.RecordBatch.from_arrays([pa.array([int(q[lo])], pa.int32()), x.column(1)], names=["q", "blob"])

    left = own.mapInArrow(pack_groups, "q int, blob binary").select("q", numbers(deals).alias("d"), F.lit(0).alias("side"), "blob")
    packed = every.mapInArrow(pack(ROW_BLOCK), "n int, blob binary").withColumn("d", F.pmod(F.col("n") + F.spark_partition_id(), F.lit(deals)))
    right = packed.select(numbers(groups).alias("q"), "d", F.lit(1).alias("side"), "blob")

    def search(batches):
        unit, asking, found, best = None, [], None, None

        def done():
            if best is None:
                return
            at, place = np.nonzero(best[1] >= NONE)
            ids, sim = best[0][at, place], best[1][at, place]
            for lo in range(0, len(at), 10_000):
                s = sim[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(found.ids[at[lo : lo + 10_000]]), pa.array(ids[lo : lo + 10_000]), pa.array(s / SCALE, mask=s == NONE)], names=["i", "other", "sim"])

        for b in batches:
            for q, d, side, blob in zip(*(b.column(j).to_pylist() for j in range(3)), (x.as_buffer() for x in b.column(3))):
                if (q, d) != unit:
                    yield from done()
                    unit, asking, found, best = (q, d), [], None, None
                t = _unpacked(blob)
                if side == 0:
                    asking.append(t)
                    continue
                if not asking:
                    continue
                if found is None:
                    found = _Block(pa.concat_tables(asking).combine_chunks())
                    best = np.zeros((len(found.ids), 0), np.int64), np.zeros((len(found.ids), 0), np.int64)
                for lo in range(0, t.num_rows, ROW_BLOCK):
                    part = t.slice(lo, ROW_BLOCK)
                    new = found.nearest(_column(part, 0).to_numpy(), _column(part, 1).to_numpy(), *_matrix(_column(part, 2)), k)
                    best = _first(*(np.concatenate(x, axis=1) for x in zip(best, new)), k)
        yield from done()

    # one group and one deal a task
    met = left.unionByName(right).repartitionById(groups * deals, F.col("q") * deals + F.col("d")).sortWithinPartitions("q", "d", "side")
    pairs = met.mapInArrow(search, "i long, other long, sim double")
    w = Window.partitionBy("i").orderBy(F.desc("sim"), "other")
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select(F.col("i").alias(id_col), "other", "sim")
