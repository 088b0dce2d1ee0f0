"""Joins of intervals that overlap, and counts of overlaps without their pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a level are so many times as wide as those of the level below.
WIDER = 8
#: Levels are -TOP to TOP.
TOP = 20
#: Intervals of a block, about, and keys of a tile.
BLOCK, TILE = 2_000_000, 4096
#: Runs of up to so many intervals are marked together, longer ones singly.
SHORT = 32


def _placed(df: DataFrame, lo: Column, hi: Column, levels: list[int] | None, side: str) -> DataFrame:
    """Rows of ``df`` as a struct with their interval; with ``levels``, once for each bin at their own level and at each coarser one."""
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(side), lo.cast("double").alias(f"{side}_lo"), hi.cast("double").alias(f"{side}_hi"))
    own = own.where(F.col(f"{side}_lo") <= F.col(f"{side}_hi"))
    size = F.col(f"{side}_hi") - F.col(f"{side}_lo")
    # the least level whose bins are at least as wide as the interval, so that it lies in two of them at most
    level = F.least(F.lit(TOP), F.greatest(F.lit(-TOP), F.ceil(F.log(F.greatest(size, F.lit(1e-30))) / F.log(F.lit(float(WIDER)))).cast("int")))
    own = own.withColumn(f"{side}_home", level + F.when(size > F.pow(F.lit(float(WIDER)), level), 1).otherwise(0))
    if levels is None:
        return own
    at = own.withColumn("level", F.explode(F.filter(F.array(*(F.lit(x) for x in levels)).cast("array<int>"), lambda x: x >= F.col(f"{side}_home"))))
    width = F.pow(F.lit(float(WIDER)), F.col("level"))
    first, last = F.floor(F.col(f"{side}_lo") / width), F.floor(F.col(f"{side}_hi") / width)
    return at.withColumn(f"{side}_first", first).withColumn("bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, left_on: tuple[Column, Column], right_on: tuple[Column, Column], by: list[str] | None = None) -> DataFrame:
    """Pairs (left, right: structs of the rows) whose closed intervals have a point in common, and equal ``by`` if given.

    Bins have levels, each WIDER times as wide as the one below. An interval's home is the level whose bins are as wide as it is, where
    it lies in two at most; two intervals meet at the home of the longer one, so a long interval is no row for each short bin that it covers. A pair
    that shares two bins is given in the first. The join hashes bins and ``by``; its size beyond that is that of the result. Intervals with a
    null end, or that end before they begin, match nothing; null ``by`` match nothing. Numbers are compared as doubles.
    """
    homes = lambda df, on, side: _placed(df, *on, None, side).select(F.col(f"{side}_home").alias("home")).distinct()
    levels = sorted(r.home for r in homes(left, left_on, "left").union(homes(right, right_on, "right")).distinct().collect())  # 2 * TOP + 2 at most
    a, b = _placed(left, *left_on, levels, "left"), _placed(right, *right_on, levels, "right")
    for c in by or []:
        a, b = a.withColumn(f"by_{c}", F.col(f"left.`{c}`")), b.withColumn(f"by_{c}", F.col(f"right.`{c}`"))
    met = a.join(b, ["level", "bin", *(f"by_{c}" for c in by or [])])
    tests = [
        F.col("left_lo") <= F.col("right_hi"), F.col("right_lo") <= F.col("left_hi"),
        F.col("level") == F.greatest("left_home", "right_home"), F.col("bin") == F.greatest("left_first", "right_first"),
    ]
    return met.where(reduce(lambda x, y: x & y, tests)).select("left", "right")


class _Tile:
    """Intervals of some keys: the keys, and by ``lo`` the place of each interval's key, ``lo`` and ``hi``."""

    def __init__(self, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.keys, of = np.unique(keys, return_inverse=True)
        order = np.argsort(lo, kind="stable")
        self.of, self.lo, self.hi, self.ends = of[order], lo[order], hi[order], np.sort(hi)

    def overlaps(self, other: _Tile) -> np.ndarray:
        """For each interval how many of the other tile's have a point in common with it."""
        return np.searchsorted(other.lo, self.hi, "right") - np.searchsorted(other.ends, self.lo, "left")

    def total(self, each: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, each, len(self.keys)).astype(np.int64)


def _mark(met: np.ndarray, rows: np.ndarray, columns: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
    """In row ``rows[i]`` of ``met`` mark ``columns[first[i] : last[i]]``."""
    n = last - first
    long = np.flatnonzero(n > SHORT)
    for row, lo, hi in zip(rows[long].tolist(), first[long].tolist(), last[long].tolist()):
        met[row][columns[lo:hi]] = True
    short = np.flatnonzero((n > 0) & (n <= SHORT))
    for part in np.array_split(short, len(short) // 50_000 + 1):
        m = n[part]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[part], m)
        met[np.repeat(rows[part], m), columns[at]] = True


def _tiles(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[_Tile]:
    order = np.argsort(keys, kind="stable")
    keys, lo, hi = keys[order], lo[order], hi[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[::TILE].tolist()
    return [_Tile(keys[x:y], lo[x:y], hi[x:y]) for x, y in zip(starts, [*starts[1:], len(keys)])]


def _tile_counts(a: _Tile, b: _Tile) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, overlaps with intervals of other keys, other keys) of tile ``a``, and of ``b`` where it is another one."""
    met = np.zeros((len(a.keys), len(b.keys)), bool)
    # of two that overlap, one begins within the other: the right one in the left one, or the left one after the right one's beginning
    _mark(met, a.of, b.of, np.searchsorted(b.lo, a.lo, "left"), np.searchsorted(b.lo, a.hi, "right"))
    back = np.zeros((len(b.keys), len(a.keys)), bool)
    _mark(back, b.of, a.of, np.searchsorted(a.lo, b.lo, "right"), np.searchsorted(a.lo, b.hi, "right"))
    met |= back.T
    n = a.total(a.overlaps(b))
    if a is not b:
        yield a.keys, n, met.sum(1)
        yield b.keys, b.total(b.overlaps(a)), met.sum(0)
        return
    # a key's own intervals are no others: in its order of (key, lo) an interval overlaps its key's from some on
    np.fill_diagonal(met, False)
    order = np.argsort(a.of, kind="stable")
    cut = np.searchsorted(a.of[order], np.arange(len(a.keys) + 1))
    for i, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        lo, hi = a.lo[order[x:y]], a.hi[order[x:y]]
        n[i] -= y - x if y - x == 1 or (lo[1:] > np.maximum.accumulate(hi)[:-1]).all() else (np.searchsorted(lo, hi, "right") - np.searchsorted(np.sort(hi), lo, "left")).sum()
    yield a.keys, n, met.sum(1)


def overlap_counts(df: DataFrame, key: str, lo: str, hi: str, block: int = BLOCK) -> DataFrame:
    """key (long), n, others: for every key the pairs of one of its closed intervals and one of another key's that have a point in common, and how many other keys there are in these; keys with none are left out.

    Pairs are no rows. Keys are dealt into blocks of about ``block`` intervals, and every two blocks meet in one task, which counts the pairs by positions in
    sorted ends and marks the keys that meet in a matrix of two tiles of TILE keys, one after the other. A task holds two blocks and one
    matrix; the keys that meet are as many as their square, so time grows with it, by a byte a pair of keys and a mark a pair of intervals. A key is
    in one block, with all its intervals. Null keys, null ends and intervals that end before they begin match nothing. Numbers are compared as doubles.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(lo).cast("double").alias("lo"), F.col(hi).cast("double").alias("hi")).where("k IS NOT NULL AND lo <= hi")
    count = rows.count()
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # as many blocks as their size needs, or as give the cluster tasks, if not tiny
    blocks = max(1, -(-count // block), min(int(np.ceil(np.sqrt(2 * slots))), count // 5000))

    def pack(batches):
        for b in batches:
            at, k, x, y = (b.column(j).to_numpy() for j in range(4))
            cut = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else [0]
            out = [(int(at[p]), np.concatenate([k[p:q].view(np.float64), x[p:q], y[p:q]]).tobytes()) for p, q in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["b", "blob"])

    own = rows.select(F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("b"), "k", "lo", "hi").repartition(blocks, "b").sortWithinPartitions("b", "k")
    packed = own.mapInArrow(pack, "b int, blob binary")
    met = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "blob")
    # the number of a pair of blocks is its task
    met = met.repartitionById(blocks * (blocks + 1) // 2, (F.col("j") * (F.col("j") + 1) / 2 + F.col("i")).cast("int"))

    def count_all(batches):
        sides: dict[int, list] = {}
        pair: set[int] = set()
        for batch in batches:
            for i, j, b, blob in zip(*(batch.column(c).to_pylist() for c in range(4))):
                pair |= {i, j}
                sides.setdefault(b, []).append(np.frombuffer(blob).reshape(3, -1))
        if not sides or len(sides) < len(pair):
            return
        tiles = []
        for b in sorted(sides):
            k, x, y = np.concatenate(sides.pop(b), axis=1)
            tiles.append(_tiles(np.ascontiguousarray(k).view(np.int64), x, y))
        left, right = tiles[0], tiles[-1]
        for p, a in enumerate(left):
            for b in right[p:] if len(tiles) == 1 else right:
                for keys, n, others in _tile_counts(a, b):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(others.astype(np.int64))], names=["k", "n", "others"])

    counted = met.mapInArrow(count_all, "k long, n long, others long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("others").alias("others"))
    return counted.where("n > 0").select(F.col("k").alias(key), "n", "others")
