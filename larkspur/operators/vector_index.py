"""An index of vectors by inverted lists: every row in the list of its nearest centre, a few lists searched exactly."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.vectors import _column, _matrix

#: Rows that the centres are fitted on at most, chosen by hash, and centres at most.
SAMPLE, CENTRES = 20_000, 1024
#: Of the nearest of the sample's own rows, the share that the lists to be searched must hold.
RECALL = 0.97
#: Rows of a list that one task compares, about.
DEAL = 50_000
#: Routed queries of a batch, and products of queries and rows at a time, about (4 MB).
ROUTED, PRODUCTS = 4096, 1 << 19


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _nearest_centres(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(vectors @ centres.T), axis=1, kind="stable")[:, :n]


def fit(sample: np.ndarray, k: int, recall: float = RECALL, rounds: int = 12) -> tuple[np.ndarray, int]:
    """Centres by spherical Lloyd's rounds on unit vectors, and how many lists to search: the fewest that hold ``recall`` of the ten
    nearest of every 20th vector of the sample."""
    n = max(1, min(CENTRES, int(np.sqrt(len(sample)))))
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest_centres(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    own = _nearest_centres(sample, centres, 1)[:, 0]
    asked = sample[::20]
    true = np.argsort(-(asked @ sample.T), axis=1)[:, : k + 1]
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each list, for each asked vector
    need = np.sort(rank[np.arange(len(asked))[:, None], own[true]].ravel())
    return centres, int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1


def build(rows: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, sample: int = SAMPLE) -> None:
    """Write an index of all rows with a vector of some length to ``path``: one folder a list, and the centres beside them.

    Centres and the number of lists to search come from at most ``sample`` rows, the first by a hash of their id; every row is put into
    a list. Null and zero vectors have no direction and null ids no name: they are not in the index. Vectors have one length.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v")).where("i IS NOT NULL AND v IS NOT NULL")
    own = own.where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) > 0)
    first = own.orderBy(F.xxhash64("i"), "i").limit(sample).select("v").toArrow()  # ``sample`` rows at most
    vectors = _matrix(_column(first, 0))[0] if first.num_rows else np.zeros((1, 1))
    centres, lists = fit(_unit(vectors), k)

    def assign(batches):
        for b in batches:
            at = _nearest_centres(_unit(_matrix(b.column(1))[0]), centres, 1)[:, 0] if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32))], names=["i", "v", "list"])

    own.mapInArrow(assign, "i long, v array<double>, list int").repartition("list").write.partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(json.dumps({"centres": centres.tolist(), "search": lists}),)], "value string").coalesce(1).write.text(f"{path}/centres")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None) -> DataFrame:
    """``id_col``, other, sim (cosine, five decimals), compared: the ``k`` nearest rows in the lists nearest to each query, without rows of the query's own id.

    Cosines are exact; a row in a list that is not searched is missed. ``compared``: rows that the query was compared with. Each query goes to
    ``lists`` lists (as many as were fitted, if absent), and meets each list's rows in deals of bounded size, where the ``k`` best are kept.
    """
    known = json.loads(spark.read.text(f"{path}/centres").first()[0])
    centres, n = np.array(known["centres"]), min(lists or known["search"], len(known["centres"]))
    stored = spark.read.schema("i long, v array<double>, list int").parquet(f"{path}/lists")

    def route(batches):
        """Each query once for each of its lists, in batches of about ROUTED rows however many queries come at once."""
        step = max(1, ROUTED // n)
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                at = _nearest_centres(_unit(_matrix(b.column(1))[0]), centres, n)
                of = pa.array(np.repeat(np.arange(b.num_rows), n))
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(at.ravel().astype(np.int32))], names=["i", "v", "list"])

    asked = queries.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v")).where("i IS NOT NULL AND v IS NOT NULL")
    sizes = stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("deals"))  # one row a list
    routed = asked.mapInArrow(route, "i long, v array<double>, list int").join(sizes, "list").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    dealt = stored.join(sizes, "list").withColumn("deal", F.pmod(F.xxhash64("i"), F.col("deals")).cast("int"))
    both = routed.select("list", "deal", F.lit(0).alias("side"), "i", "v").unionByName(dealt.select("list", "deal", F.lit(1).alias("side"), "i", "v"))

    def compare(batches):
        unit, ids, vectors, best = None, np.zeros(0, np.int64), np.zeros((0, 0)), []

        def flush(names, rows):
            """Compare the unit's queries with some of its rows."""
            step = max(1, PRODUCTS // max(1, len(rows)))
            for lo in range(0, len(ids), step):
                sims = np.round(vectors[lo : lo + step] @ rows.T, 5)
                for a, row in enumerate(sims, lo):
                    at = np.flatnonzero(names != ids[a])
                    order = at[np.lexsort((names[at], -row[at]))[:k]]
                    found, n = best[a]
                    best[a] = sorted([*found, *zip((-row[order]).tolist(), names[order].tolist())])[:k], n + len(at)

        def done():
            # how many rows were compared goes with the first row of each query
            out = [(i, o, -s + 0.0, n if j == 0 else 0) for i, (found, n) in zip(ids.tolist(), best) for j, (s, o) in enumerate(found)]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["i", "other", "sim", "n"])

        for b in batches:
            lst, deal, side, names = (b.column(j).to_numpy() for j in range(4))
            rows = _unit(_matrix(b.column(4))[0])
            new = np.flatnonzero((lst[1:] != lst[:-1]) | (deal[1:] != deal[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(lst)]):
                if lo == hi:
                    continue
                if (lst[lo], deal[lo]) != unit:
                    if len(ids):
                        yield done()
                    unit, ids, vectors, best = (lst[lo], deal[lo]), ids[:0], rows[:0], []
                if side[lo] == 0:
                    ids, vectors = np.concatenate([ids, names[lo:hi]]), np.concatenate([vectors, rows[lo:hi]])
                    best += [([], 0)] * (hi - lo)
                elif len(ids):
                    flush(names[lo:hi], rows[lo:hi])
        if len(ids):
            yield done()

    met = both.repartition("list", "deal").sortWithinPartitions("list", "deal", "side").mapInArrow(compare, "i long, other long, sim double, n long")
    total = met.groupBy("i", "other").agg(F.max("sim").alias("sim"), F.sum("n").alias("n"))
    w = Window.partitionBy("i")
    ranked = total.withColumn("rn", F.row_number().over(w.orderBy(F.desc("sim"), "other"))).withColumn("n", F.sum("n").over(w)).where(F.col("rn") <= k)
    return ranked.select(F.col("i").alias(id_col), "other", "sim", F.col("n").alias("compared"))
