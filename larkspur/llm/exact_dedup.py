"""Exact deduplication by Grace hashing.

Records are partitioned by bits of their content digest into buckets; a bucket that would not fit is
written out and partitioned again by the next bits, until each bucket's distinct contents fit an
open-addressing table that compares complete contents. Copies are first collapsed where they are read,
by the same table, so that a text that fills a third of the rows reaches its bucket once per task.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import documents, staged

#: Bytes of text that one table may hold: in a task before copies are flushed, and in a bucket.
TABLE_BYTES = 48 << 20
#: Bytes of text that one task reads, about: its buckets come one after the other.
TASK_BYTES = 128 << 20
#: Buckets into which one level splits a bucket that is too large.
FAN = 16
#: The columns beside those of the documents.
KINDS = [T.StructField("kind", T.ByteType()), *(T.StructField(c, T.BinaryType() if c == "sha" else T.LongType()) for c in ("uid", "doc_id", "sha", "gid", "n", "n_bytes"))]
OWN = [pa.field("kind", pa.int8()), *(pa.field(c, pa.binary() if c == "sha" else pa.int64()) for c in ("uid", "doc_id", "sha", "gid", "n", "n_bytes"))]
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space as one space; other bytes, and so all of UTF-8, stay."""
    text = text.translate(_SPACES)
    while b"  " in text:
        text = text.replace(b"        ", b" ").replace(b"  ", b" ")
    return text


class ContentTable:
    """Open addressing with linear probing: slots hold entry numbers, and contents decide equality."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.held = 0

    def entry(self, content: bytes, digest: bytes) -> int:
        """The number of the entry with this content, new or old."""
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        h = int.from_bytes(digest[8:16], "little")
        mask = len(self.slots) - 1
        at = h & mask
        while (e := int(self.slots[at])) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            at = (at + 1) & mask
        self.slots[at] = e = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.held += len(content)
        return e

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def _collapse(batches: Iterable[pa.RecordBatch], text_at: int, id_at: int, table_bytes: int) -> Iterator[pa.RecordBatch]:
    """Members (kind 0: uid, id, digest, group) and, per distinct text since the last flush, a group (kind 1) with the row of its smallest id."""
    uid = TaskContext.get().partitionId() << 40
    table, seen, groups, digests, read = ContentTable(), [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        by_batch = defaultdict(list)
        for e, g in enumerate(groups):
            by_batch[g[0]].append(e)
        for k, entries in by_batch.items():
            rows = seen[k].take(pa.array([groups[e][1] for e in entries]))
            _, _, ids, uids, firsts, counts = zip(*(groups[e] for e in entries))
            sizes = [len(table.contents[e]) for e in entries]
            own = [pa.array([1] * len(entries), pa.int8()), *(pa.array(x, pa.int64()) for x in (uids, ids)), pa.array([digests[e] for e in entries], pa.binary())]
            own += [pa.array(x, pa.int64()) for x in (firsts, counts, sizes)]
            yield pa.RecordBatch.from_arrays(own + rows.columns, schema=schema)

    for batch in batches:
        schema = pa.schema([*OWN, *(pa.field(f"c{i}", f.type) for i, f in enumerate(batch.schema))])
        n, ids, texts = batch.num_rows, batch.column(id_at).cast(pa.int64()).to_pylist(), batch.column(text_at)
        seen.append(batch)
        read += batch.nbytes
        shas, firsts = [], np.empty(n, np.int64)
        for i in range(n):
            t = texts[i].as_py()
            content = normalised(t.encode() if t else b"")
            shas.append(digest := hashlib.sha256(content).digest())
            e = table.entry(content, digest)
            if e == len(groups):
                groups.append([len(seen) - 1, i, ids[i], uid + i, uid + i, 0])
                digests.append(digest)
            elif _before(ids[i], uid + i, groups[e][2], groups[e][3]):
                groups[e][:4] = len(seen) - 1, i, ids[i], uid + i
            groups[e][5] += 1
            firsts[i] = groups[e][4]
        own = [pa.array(np.zeros(n, np.int8)), pa.array(np.arange(uid, uid + n)), pa.array(ids, pa.int64()), pa.array(shas, pa.binary()), pa.array(firsts)]
        yield pa.RecordBatch.from_arrays(own + [pa.nulls(n, f.type) for f in list(schema)[5:]], schema=schema)
        uid += n
        if read > table_bytes:
            yield from flush()
            table, seen, groups, digests, read = ContentTable(), [], [], [], 0
    yield from flush()


def _before(a, a_uid, b, b_uid) -> bool:
    """Smaller id first, null last, ties by uid."""
    return (a is None, a or 0, a_uid) < (b is None, b or 0, b_uid)


def _bucket_tables(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come bucket by bucket (bucket, gid, id, uid, n, digest, text): one table a bucket, one row out per group in."""
    now = None
    table, best, total, groups = ContentTable(), [], [], []

    def done() -> Iterator[pa.RecordBatch]:
        if groups:
            e = [g[1] for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups], pa.int64()), pa.array([best[x][0] for x in e], pa.int64()), pa.array([best[x][1] for x in e], pa.int64()), pa.array([total[x] for x in e], pa.int64())], schema=schema)

    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns[:6]]
        texts = batch.column(6)
        for i in range(batch.num_rows):
            bucket, gid, doc, uid, n, digest = (c[i] for c in cols)
            if bucket != now:
                yield from done()
                now, table, best, total, groups = bucket, ContentTable(), [], [], []
            t = texts[i].as_py()
            e = table.entry(normalised(t.encode() if t else b""), digest)
            if e == len(best):
                best.append((doc, uid))
                total.append(0)
            elif _before(doc, uid, *best[e]):
                best[e] = (doc, uid)
            total[e] += n
            groups.append((gid, e))
    yield from done()


def grace_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, groups, verdicts) of the exact duplicates in ``docs``.

    members: uid, doc_id, sha, gid for every row. groups: one row per text and reading task, with the
    columns of its first row as c0, c1, ... verdicts: gid, keep_id, keep_uid, group_size.
    """
    at = {c: i for i, c in enumerate(docs.columns)}
    out = T.StructType(KINDS + [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    text_at, id_at = at[text_col], at[id_col]

    def collapse(batches):
        return _collapse(batches, text_at, id_at, table_bytes)

    spread = staged(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(collapse, out), "grace-rows")
    members = spread.where("kind = 0").select("uid", "doc_id", "sha", "gid")
    groups = spread.where("kind = 1")

    light = pa.schema([("gid", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64())])

    def tables(batches):
        return _bucket_tables(batches, light)

    pending = groups.select("gid", "doc_id", "uid", "n", "sha", "n_bytes", F.col(f"c{text_at}").alias("text"))
    size = pending.agg(F.sum("n_bytes")).first()[0] or 0
    first_fan = 1 << max(4, int(np.ceil(np.log2(1 + 2 * size / table_bytes))))
    tasks = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    ready, level = [], 0
    while True:
        pending = pending.withColumn("bucket", _bucket(level, first_fan))
        per = pending.groupBy("bucket", "sha").agg(F.max("n_bytes").alias("b")).groupBy("bucket").agg(F.sum("b").alias("b"), F.count("b").alias("texts"))
        over = per.where((F.col("b") > table_bytes) & (F.col("texts") > 1)).select("bucket")
        if over.isEmpty():
            ready.append(pending)
            break
        if level > 0 and _bits(level - 1, first_fan) > 60:
            raise RuntimeError("different texts share the leading 60 bits and another 64-bit hash of their digests")
        ready.append(pending.join(over, "bucket", "left_anti"))
        pending = staged(pending.join(over, "bucket", "left_semi").drop("bucket").withColumn("spill", _bucket(level + 1, first_fan)).repartition(tasks, "spill").drop("spill"), "grace-spill")
        level += 1
    verdicts = None
    for r in ready:
        dealt = r.select("bucket", "gid", "doc_id", "uid", "n", "sha", "text").repartition(tasks, "bucket").sortWithinPartitions("bucket")
        v = dealt.mapInArrow(tables, "gid long, keep_id long, keep_uid long, group_size long")
        verdicts = v if verdicts is None else verdicts.unionByName(v)
    return members, groups, verdicts


def _bits(level: int, first_fan: int) -> int:
    return (first_fan * FAN**level).bit_length() - 1


def _bucket(level: int, first_fan: int):
    """The bucket at a level, from the digest's leading bits: each level refines the one above. After 60 bits a hash of the whole digest takes over."""
    bits = _bits(level, first_fan)
    if bits > 60:
        return F.xxhash64("sha")
    head = F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long")
    return F.shiftright(head, 60 - bits)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the smallest id stays, a null id last; of rows that tie on
    the id exactly one stays. Texts of any length are compared whole. An empty table gives no rows.
    """
    members, _, verdicts = grace_groups(docs.select(id_col, text_col), id_col, text_col, table_bytes)
    return members.join(verdicts, "gid").select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` without its later copies, columns as they were."""
    _, groups, verdicts = grace_groups(docs, id_col, text_col, table_bytes)
    stays = verdicts.select(F.col("gid").alias("_g"), "keep_uid")
    return groups.join(stays, (groups["gid"] == F.col("_g")) & (groups["uid"] == F.col("keep_uid"))).select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns))
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

QUERIES = {"op2_exact_dedup": op2}
ORACLES = {"op2_exact_dedup": ORACLE}
