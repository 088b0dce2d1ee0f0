"""Compression of vectors to one byte a part: codebooks by Lloyd's rounds in whole numbers, with heaps of bounds.

A vector's components become floor(1024 * x) and are cut into equal consecutive parts; each part position has a
codebook of at most 256 entries, at first those of the smallest ids. A round assigns every part to its nearest
entry and moves every entry to the mean of its parts.

Vectors are kept in blocks, one row of a table each. After a part is scanned, the distance to its entry (upper)
and to the second nearest one (lower) are known exactly; its slack is lower less upper. When entries move, upper
grows by what its entry has drifted and lower shrinks by the largest drift of any other, so the part keeps its
entry as long as the slack exceeds the sum of both over all rounds since. A block has a heap of its parts for
each entry, keyed by slack plus the entry's cumulative drift when the part was pushed: a round pops the
parts whose key the cumulative drift has reached, scans those against all entries, and pushes them again.
Everything else stays where it is, unread. A block reports how its sums change; the driver adds up one row of
sums for each entry, so nothing that grows with the vectors leaves the tasks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from heapq import heapify, heappop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.shared import staged, unstage
from larkspur.sources import read_table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors in a block, and parts that are scanned together.
BLOCK = 16_384
SCAN = 4_096
#: Slacks and drifts are doubles: what is closer than this share of them counts as reached.
GUARD = 1e-9
_EXACT = 2**53  # whole numbers up to here are exact as doubles
STATE = "ids array<long>, extra array<string>, width int, vectors binary, kind string, codes binary, keys binary, scanned long, changes array<struct<part:int,entry:int,n:long,sums:array<long>>>"


@dataclass
class Codebooks:
    """Entries (part, entry, component), how often each is used, and the sum of its parts."""

    entries: np.ndarray
    counts: np.ndarray
    sums: np.ndarray

    @classmethod
    def first(cls, vectors: np.ndarray, parts: int) -> Codebooks:
        n, size = vectors.shape
        entries = vectors.reshape(n, parts, size // parts).transpose(1, 0, 2).copy()
        return cls(entries, np.zeros((parts, n), np.int64), np.zeros(entries.shape, object))

    def moved(self, changes: list) -> tuple[Codebooks, np.ndarray]:
        """The codebooks after changes (part, entry, n, sums), and how far each entry goes."""
        counts, sums, entries = self.counts.copy(), self.sums.copy(), self.entries.copy()
        for part, entry, n, more in changes:
            counts[part, entry] += n
            sums[part, entry] += np.array(more, object)
        for part, entry in np.argwhere(counts > 0):
            entries[part, entry] = [s // int(counts[part, entry]) for s in sums[part, entry]]
        gap = (entries - self.entries).astype(float)
        return Codebooks(entries, counts, sums), np.sqrt((gap * gap).sum(2)) * (1 + GUARD)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def vector(self, code: str) -> np.ndarray:
        """The vector that a code stands for."""
        return np.concatenate([book[i] for book, i in zip(self.entries, bytes.fromhex(code))]) / SCALE


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to rows of ``c``: as doubles where they are exact, else as Python's whole numbers."""
    most = max((int(np.abs(a).max()) for a in (x, c) if a.size), default=0)
    if 4 * most * most * max(1, x.shape[1]) <= _EXACT:
        x, c = x.astype(float), c.astype(float)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    x, c = x.astype(object), c.astype(object)
    return np.array([[((a - b) ** 2).sum() for b in c] for a in x], object).reshape(len(x), len(c))


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of ``c`` for each row of ``x`` (the first of equals), and the slack, less what rounding can be."""
    near, slack = np.zeros(len(x), np.uint8), np.full(len(x), np.inf)
    for lo in range(0, len(x), SCAN):
        d = squared(x[lo : lo + SCAN], c)
        at = d.argmin(1)
        near[lo : lo + SCAN] = at
        if len(c) > 1:
            rows = np.arange(len(d))
            upper = np.sqrt(d[rows, at].astype(float))
            d[rows, at] = np.inf
            lower = np.sqrt(d.min(1).astype(float))
            slack[lo : lo + SCAN] = lower - upper - GUARD * (lower + upper + 1)
    return near, slack


class Block:
    """Some vectors, the entry of each of their parts, and the heaps' keys."""

    def __init__(self, vectors: np.ndarray, parts: int, codes: np.ndarray | None = None, keys: np.ndarray | None = None) -> None:
        self.vectors, self.codes, self.keys = vectors, codes, keys
        self.split = vectors.reshape(len(vectors), parts, -1)
        self.scanned = 0

    @classmethod
    def read(cls, row: dict, parts: int) -> Block:
        vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, row["width"]).astype(np.int64)
        n = len(vectors)
        return cls(vectors, parts, np.frombuffer(row["codes"], np.uint8).reshape(parts, n).copy(), np.frombuffer(row["keys"], np.float64).reshape(parts, n).copy())

    def popped(self, part: int, drift: np.ndarray) -> np.ndarray:
        """Vectors whose bounds the cumulative drift of their entries has reached, taken from the heaps."""
        out, keys = [], self.keys[part]
        order = np.argsort(self.codes[part], kind="stable")
        bounds = np.searchsorted(self.codes[part][order], np.arange(len(drift) + 1))
        least = np.minimum.reduceat(np.append(keys[order], np.inf), np.minimum(bounds[:-1], len(order)))
        for entry in np.flatnonzero((least <= drift) & (np.diff(bounds) > 0)).tolist():
            own = order[bounds[entry] : bounds[entry + 1]]
            heap = list(zip(keys[own].tolist(), own.tolist()))
            heapify(heap)
            while heap and heap[0][0] <= drift[entry]:
                out.append(heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def assign(self, books: Codebooks, drift: np.ndarray) -> list[dict]:
        """Bring every part to its nearest entry; what that changes in the entries' counts and sums."""
        changes = []
        n, parts, width = self.split.shape
        fresh = self.codes is None
        if fresh:
            self.codes, self.keys = np.zeros((parts, n), np.uint8), np.zeros((parts, n))
        for part in range(parts):
            own = np.arange(n) if fresh else self.popped(part, drift[part])
            x, was = self.split[own, part], self.codes[part, own].copy()
            near, slack = scan(x, books.entries[part])
            self.scanned += len(own)
            self.codes[part, own], self.keys[part, own] = near, slack + drift[part][near]
            go = np.ones(len(own), bool) if fresh else near != was
            k = books.entries.shape[1]
            count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
            np.add.at(count, near[go], 1)
            np.add.at(total, near[go], x[go])
            touched = np.zeros(k, bool)
            touched[near[go]] = True
            if not fresh:
                np.add.at(count, was[go], -1)
                np.add.at(total, was[go], -x[go])
                touched[was[go]] = True
            changes += [{"part": part, "entry": e, "n": int(count[e]), "sums": total[e].tolist()} for e in np.flatnonzero(touched).tolist()]
        return changes

    def errors(self, books: Codebooks) -> list[int]:
        """Squared distances to the entries, summed over the parts."""
        gap = self.split - books.entries[np.arange(self.split.shape[1])[:, None], self.codes].transpose(1, 0, 2)
        most = int(np.abs(gap).max()) if gap.size else 0
        gap = gap if gap.shape[1] * gap.shape[2] * most * most < 2**62 else gap.astype(object)
        return (gap * gap).sum((1, 2)).tolist()

    def row(self, ids: list, extra: list, changes: list[dict]) -> dict:
        most = int(np.abs(self.vectors).max()) if self.vectors.size else 0
        kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
        return {"ids": ids, "extra": extra, "width": self.vectors.shape[1], "vectors": self.vectors.astype(kind).tobytes(), "kind": kind,
                "codes": self.codes.tobytes(), "keys": self.keys.tobytes(), "scanned": self.scanned, "changes": changes}


def whole_numbers(vectors: pa.Array, size: int) -> np.ndarray:
    """floor(SCALE * x) of vectors of ``size`` components; other sizes, and values that a long cannot hold, are errors."""
    if not (np.diff(vectors.offsets.to_numpy()) == size).all():
        raise ValueError(f"all vectors must have {size} components, as the first one has")
    x = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(x) and np.abs(x).max() >= 2.0**62:
        raise OverflowError("a component is too large for whole numbers of 64 bits")
    return x.astype(np.int64).reshape(len(vectors), size)


_ARROW = pa.schema([
    ("ids", pa.list_(pa.int64())), ("extra", pa.list_(pa.string())), ("width", pa.int32()), ("vectors", pa.binary()), ("kind", pa.string()), ("codes", pa.binary()), ("keys", pa.binary()), ("scanned", pa.int64()),
    ("changes", pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))),
])


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(F.col(vector_col).isNotNull() & ~F.coalesce(F.exists(F.col(vector_col).cast("array<double>"), bad), F.lit(False)))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, Codebooks, list[int]]:
    """A table of ``id_col``, code, error (and ``keep`` as text), the final codebooks, and how many parts each pass scanned.

    Rows with a null vector, or with null or non-finite components, are left out. Repeated rows and ids count
    each; the first entries are those of the smallest ids, of equal ids the smallest vectors, null ids last. Fewer
    vectors than ``entries`` make fewer entries; equal entries leave the later ones unused, and unused entries stay
    where they are. All vectors need one size that ``parts`` divides; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    extra = F.col(keep).cast("string") if keep else F.lit(None).cast("string")
    rows = usable(vectors, vector_col).select(F.col(id_col).cast("long").alias("id"), extra.alias("extra"), F.col(vector_col).cast("array<double>").alias("v"))
    start = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    size = len(start[0].v) if start else parts
    if size % parts:
        raise ValueError(f"{size} components do not divide into {parts} parts")
    books = Codebooks.first(whole_numbers(pa.array([r.v for r in start], pa.list_(pa.float64())), size), parts)
    drift = np.zeros(books.entries.shape[:2])
    schema = f"{id_col} long, extra string, code string, error long"

    def open_blocks(batches):
        held, count = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, block):
                held.append(b.slice(lo, block))
                count += held[-1].num_rows
                if count >= block:
                    yield first_pass(held)
                    held, count = [], 0
        if count:
            yield first_pass(held)

    def first_pass(held):
        t = pa.Table.from_batches(held).combine_chunks()
        own = Block(whole_numbers(t.column(2).combine_chunks() if t.column(2).num_chunks != 1 else t.column(2).chunk(0), size), parts)
        return pa.RecordBatch.from_pylist([own.row(t.column(0).to_pylist(), t.column(1).to_pylist(), own.assign(books, drift))], schema=_ARROW)

    def later_pass(books, drift):
        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    (row,) = b.slice(i, 1).to_pylist()
                    own = Block.read(row, parts)
                    yield pa.RecordBatch.from_pylist([own.row(row["ids"], row["extra"], own.assign(books, drift))], schema=_ARROW)

        return run

    def last_pass(books, drift):
        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    (row,) = b.slice(i, 1).to_pylist()
                    own = Block.read(row, parts)
                    own.assign(books, drift)
                    text = np.ascontiguousarray(own.codes.T).tobytes().hex()
                    codes = [text[j : j + 2 * parts] for j in range(0, len(text), 2 * parts)]
                    yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["extra"], pa.string()), pa.array(codes, pa.string()), pa.array(own.errors(books), pa.int64())], names=[id_col, "extra", "code", "error"])

        return run

    scanned = []
    state = staged(rows.mapInArrow(open_blocks, STATE), "codes-0")
    for n in range(1, rounds + 1):
        said = state.select(F.inline("changes")).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(size // parts))).alias("sums"))
        books, gone = books.moved([tuple(r) for r in said.collect()])  # one row for each part and entry at most
        scanned.append(state.agg(F.sum("scanned")).first()[0] or 0)
        if gone.size:
            # the largest drift among the others: the second largest for the entry that goes farthest
            top = np.sort(gone, 1)[:, -2:] if gone.shape[1] > 1 else np.hstack([np.zeros((parts, 1)), gone])
            others = np.where(gone == top[:, 1:], top[:, :1], top[:, 1:])
            others[(gone == top[:, 1:]).sum(1) > 1] = top[(gone == top[:, 1:]).sum(1) > 1, 1:]
            drift = (drift + gone + others) * (1 + GUARD)
        if n < rounds:
            before, state = state, staged(state.mapInArrow(later_pass(books, drift), STATE), f"codes-{n}")
            unstage(before)
    out = staged(state.mapInArrow(last_pass(books, drift), schema), "codes")
    unstage(state)
    return (out.withColumnRenamed("extra", keep) if keep else out.drop("extra")), books, scanned


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, with the error summed over equal labels: sums combine before the shuffle, and are joined back."""
    codes, books, _ = compress(read_table(spark, sf_dir, "embeddings"), keep="label")
    total = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = codes.join(total, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as chained common tables. A quotient is rounded down by taking off what the division leaves."""
    floor = lambda s, n: f"(({s}) - ((({s}) % {n}) + {n}) % {n}) // {n}"
    text = [f"""
kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT r, u.k AS part, v[u.k * len(v) // {PARTS} + 1 : (u.k + 1) * len(v) // {PARTS}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS k) u),
b0 AS (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {ENTRIES})"""]
    for n in range(ROUNDS + 1):
        text.append(f"""
d{n} AS MATERIALIZED (SELECT r, p.part, entry, x, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN b{n} ON p.part = b{n}.part),
a{n} AS MATERIALIZED (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(x) AS x FROM d{n} GROUP BY r, part)""")
        if n < ROUNDS:
            text.append(f"""
s{n} AS (SELECT part, entry, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY ALL),
m{n} AS (SELECT part, entry, list({floor("s", "n")} ORDER BY i) AS c FROM s{n} GROUP BY part, entry),
b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{n}.c, b{n}.c) AS c FROM b{n} LEFT JOIN m{n} USING (part, entry))""")
    text.append(f"""
code AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})""")
    return f"WITH {','.join(text)}\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN code USING (r), h"


QUERIES = {"op13_heap_lloyd": op13}
ORACLES: dict[str, str] = {"op13_heap_lloyd": _sql()}
