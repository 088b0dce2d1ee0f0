"""Jaccard join of documents' word shingles by vertical partitioning of the order of all shingles.

The order of all shingles is that of their hashes. It is cut into fragments, and with it every document's set into
segments. Two sets of at most s shingles that are similar enough differ in at most d of them, and each of
those spoils one fragment; so of more than d fragments at least one holds the same segment of both. Sizes fall into
classes with a cut each; a set takes part in the cut of its class and, where larger partners can lie in the next
class, in that one too. Equal segments of one cut meet by the shuffle: a group. No counts of shingles are needed, and a
passage or line that many documents share makes no group unless it is nearly all of them.

A group's first set is its hub. Overlaps are counted fragment by fragment: the tokens of a hub's fragment
and those of the sets to compare meet in a task, which counts them; the counts are summed for each pair. Each set
is compared with the hub it shares most segments with. What is left are hubs whose sets are in different components: they
meet in blocks of bounded size, where all overlaps of a block are counted together and links alone leave the task. So no
pair of a group is overlooked, and a group of near copies costs its size, not the square of it.

Equal sets are one set from the beginning, so copies take part once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bytes_view as bv
from larkspur.llm.components import components
from larkspur.llm.shared import documents, staged, unstage

WIDTH = 4
#: Two sets are linked when 100 * intersection >= 85 * union.
LEAST = (85, 100)
#: Shingles of a hub in one fragment of the count, about; sets compared with a hub in one task.
FRAGMENT = 16_384
DEALT = 1_000
#: Sets that meet in a block, where each thousand shingles count as one set.
BLOCK = 400
#: A shingle of more sets of a block than this is counted by matrix product.
COMMON = 48
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEY = 6  # bytes of a segment's key
_HIGH = np.uint64(32)


class Cuts:
    """Classes of sizes and how many fragments the order is cut into for each."""

    def __init__(self, least: tuple[int, int]) -> None:
        self.num, self.den = least
        bounds = [1]
        while bounds[-1] < 1 << 40:  # a class spans two steps of the largest ratio of similar sizes
            bounds.append(self.largest(self.largest(bounds[-1])) + 1)
        self.bounds = np.array(bounds, np.int64)
        differ = 2 * (self.bounds[1:] - 1) * (self.den - self.num) // (self.den + self.num)
        #: Fragments that may be empty in a set without its having to say so.
        self.spare = 2 + differ // 32
        #: No fragments where only equal sets are similar.
        self.fragments = np.where(differ > 0, differ + 1 + self.spare, 0)

    def largest(self, size):
        """Of the sizes that a similar set can have."""
        return size * self.den // self.num

    def of(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of the two cuts that a set can take part in: its class, and the number of fragments or 0."""
        own = np.searchsorted(self.bounds, sizes, side="right") - 1
        own = np.maximum(own, 0)
        up = self.largest(sizes) >= self.bounds[own + 1]
        return [(own, np.where(sizes > 0, self.fragments[own], 0)), (own + 1, np.where(up, self.fragments[own + 1], 0))]


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text as sorted hashes, one text after the other, and where each begins (one more entry)."""
    low = _LOWER[buf]
    starts, ends, first = bv.words(low, offsets)
    h, n = bv.window_hash(bv.spans_hash(low, starts, ends), first, width)
    bounds = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][n > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def segment_keys(h: np.ndarray, first: np.ndarray, cuts: Cuts) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all segments of all sets, and the set of each, in order of the sets."""
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    keys, owners = [], []
    for kind, fragments in cuts.of(sizes):
        fragment = ((h >> _HIGH) * fragments[doc].astype(np.uint64)) >> _HIGH
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (fragment[1:] != fragment[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(bv.mix(h + bv.GOLD), at) if len(at) else h[:0]
        name = bv.mix((kind[doc[at]].astype(np.uint64) << np.uint64(40) | fragment[at]) * bv.GOLD)
        part = fragments[doc[at]] > 0
        keys.append(bv.mix(total + name)[part])
        owners.append(doc[at][part])
        # similar sets can agree in empty fragments alone only if both have more of them than are spared
        empty = fragments - np.bincount(doc[at], minlength=len(sizes))
        say = np.flatnonzero((fragments > 0) & (empty > cuts.spare[kind]))
        keys.append(bv.mix(~kind[say].astype(np.uint64)))
        owners.append(say)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], owners[order]


def _digests(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    raw = memoryview(h.tobytes())
    return [hashlib.sha256(raw[8 * a : 8 * b]).digest()[:16] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` bytes that lie one after the other in ``data``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def signed(docs: DataFrame, id_col: str, text_col: str, width: int, cuts: Cuts | None = None) -> DataFrame:
    """doc_id, n (size of the set), digest of the set; with ``cuts`` also its segments' keys."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offsets in bv.chunks(batch.column(1)):
                h, first = shingle_sets(buf, offsets, width)
                cols = [ids.slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(_digests(h, first), pa.binary())]
                if cuts:
                    keys, owner = segment_keys(h, first, cuts)
                    cols.append(_binary(keys.view(np.uint8).reshape(-1, 8)[:, :_KEY], _KEY * np.bincount(owner, minlength=hi - lo)))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "digest", "keys"][: len(cols)])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n long, digest binary" + (", keys binary" if cuts else ""))


def stars(keyed: DataFrame) -> DataFrame:
    """hub, rep, shared: of each group its first set, each other one, and how many groups they have together."""

    def unpack(batches):
        for b in batches:
            held = b.column(1).to_pylist()
            sizes = np.array([len(x) for x in held], np.int64)
            raw = np.frombuffer(b"".join(held), np.uint8).reshape(-1, _KEY)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :_KEY] = raw
            key, rep = wide.reshape(-1).view(np.int64), np.repeat(b.column(0).to_numpy(), sizes // _KEY)
            for lo in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 100_000]), pa.array(rep[lo : lo + 100_000])], names=["key", "rep"])

    def meet(batches):
        key, hub = None, None  # of the group that the last batch ended in
        for b in batches:
            k, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            new[0] = k[0] != key
            head = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            own = np.where(head >= 0, rep[head], hub if hub is not None else -1)
            key, hub = k[-1], own[-1]
            other = own != rep
            pairs, n = np.unique(np.stack([own[other], rep[other]]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n)], names=["hub", "rep", "shared"])

    rows = keyed.select("rep", "keys").mapInArrow(unpack, "key long, rep long")
    met = rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(meet, "hub long, rep long, shared long")
    return met.groupBy("hub", "rep").agg(F.sum("shared").alias("shared"))


def _sets(batch: pa.RecordBatch, text: int, digest: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and set of the rows whose text has the digest it should have: an id can have other texts as well."""
    for lo, _, buf, offsets in bv.chunks(batch.column(text)):
        h, first = shingle_sets(buf, offsets, width)
        for i, d in enumerate(_digests(h, first)):
            if d == batch.column(digest)[lo + i].as_py():
                yield lo + i, h[first[i] : first[i + 1]]


def overlaps(pairs: DataFrame, texts: DataFrame, least: tuple[int, int], width: int, fragment: int = FRAGMENT, dealt: int = DEALT) -> DataFrame:
    """hub, rep of those ``pairs`` (hub, rep, n_hub, n_rep) that are similar: overlaps counted by fragments and summed."""
    num, den = least

    def cut(batches):
        for b in batches:
            hub, salt, side, who, n = (b.column(i).to_pylist() for i in range(5))
            out = []
            for i, h in _sets(b, 5, 6, width):
                parts = n[i] // fragment + 1
                bounds = np.searchsorted(((h >> _HIGH) * np.uint64(parts)) >> _HIGH, np.arange(parts + 1, dtype=np.uint64))
                out += [(hub[i], p, salt[i], side[i], who[i], h[x:y].tobytes()) for p, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if x < y]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int8(), pa.int64(), pa.binary()))], names=["hub", "part", "salt", "side", "who", "tokens"])

    def count(batches):
        unit, own, last = None, None, None
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            out, tokens, sizes = [], [], []

            def done():
                if tokens:
                    t = np.concatenate(tokens)
                    at = np.minimum(np.searchsorted(own, t), len(own) - 1)
                    hit = np.concatenate([[0], np.cumsum(own[at] == t)])
                    ends = np.cumsum(sizes)
                    out.extend(zip(whose, (hit[ends] - hit[ends - sizes]).tolist()))

            whose: list = []
            for i, (hub, part, salt, side, who) in enumerate(zip(*cols)):
                if (hub, part, salt) != unit:
                    done()
                    tokens, sizes, whose = [], [], []
                    unit, own, last = (hub, part, salt), np.zeros(0, np.uint64), None
                if (side, who) == last:
                    continue  # a row that comes again
                last = side, who
                t = np.frombuffer(b.column(5)[i].as_py(), np.uint64)
                if side == 0:
                    own = t
                elif len(own):
                    tokens.append(t)
                    sizes.append(len(t))
                    whose.append((hub, who))
            done()
            yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in out], pa.int64()), pa.array([r[0][1] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], names=["hub", "rep", "common"])

    many = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / dealt).cast("int").alias("salts")).where("salts > 1")
    pairs = pairs.join(many, "hub", "left").withColumn("salt", F.pmod(F.xxhash64("rep"), F.coalesce("salts", F.lit(1))).cast("int"))
    member = pairs.join(texts.withColumnRenamed("rep", "who"), F.col("rep") == F.col("who")).select("hub", "salt", F.lit(1).cast("tinyint").alias("side"), "who", F.col("n_hub").alias("n"), "text", "digest")
    hubs = pairs.select("hub", "salt", "n_hub").distinct().join(texts.withColumnRenamed("rep", "who"), F.col("hub") == F.col("who"))
    rows = member.unionByName(hubs.select("hub", "salt", F.lit(0).cast("tinyint").alias("side"), "who", F.col("n_hub").alias("n"), "text", "digest"))
    tokens = rows.mapInArrow(cut, "hub long, part int, salt int, side tinyint, who long, tokens binary")
    parts = tokens.repartition("hub", "part", "salt").sortWithinPartitions("hub", "part", "salt", "side", "who").mapInArrow(count, "hub long, rep long, common long")
    summed = parts.groupBy("hub", "rep").agg(F.sum("common").alias("common"))
    sized = summed.join(pairs.select("hub", "rep", "n_hub", "n_rep"), ["hub", "rep"])
    return sized.where((num + den) * F.col("common") >= num * (F.col("n_hub") + F.col("n_rep"))).select("hub", "rep")


def block_links(sets: list[np.ndarray], comp: np.ndarray, least: tuple[int, int], common: int = COMMON) -> list[tuple[int, int]]:
    """Pairs of similar sets, as many as join the components that they are in."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    token, first, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(first, kind="stable")
    ends = np.cumsum(df)
    count = np.zeros(n * n, np.float32)
    for d in np.unique(df[(df > 1) & (df <= common)]).tolist():
        i, j = np.triu_indices(d, 1)
        heads = (ends - df)[df == d]
        step = max(1, 2_000_000 // len(i))
        for lo in range(0, len(heads), step):
            own = owner[order[heads[lo : lo + step, None] + np.arange(d)]]
            count += np.bincount((own[:, i] * n + own[:, j]).ravel(), minlength=n * n)
    wide = np.flatnonzero(df > common)
    for lo in range(0, len(wide), 4096):
        some = wide[lo : lo + 4096]
        there = np.zeros((n, len(some)), np.float32)
        there[owner[order[bv.ranges((ends - df)[some], df[some])]], np.repeat(np.arange(len(some)), df[some])] = 1
        count += np.triu(there @ there.T, 1).ravel()
    num, den = least
    near = (num + den) * count.reshape(n, n).astype(np.int64) >= num * (sizes[:, None] + sizes)
    top, links = {c: c for c in comp.tolist()}, []

    def find(c):
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    for i, j in np.argwhere(np.triu(near & (comp[:, None] != comp), 1)).tolist():
        p, q = find(int(comp[i])), find(int(comp[j]))
        if p != q:
            top[max(p, q)] = min(p, q)
            links.append((i, j))
    return links


def left_over(lists: DataFrame, texts: DataFrame, least: tuple[int, int], width: int, block: int = BLOCK) -> DataFrame:
    """hub, rep: links between members of different components in each hub's list (hub, rep, comp, n)."""

    def run(batches):
        unit, rows = None, []

        def done():
            links = block_links([r[2] for r in rows], np.array([r[1] for r in rows]), least) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([rows[x[k]][0] for x in links], pa.int64()) for k in (0, 1)], names=["hub", "rep"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for i, h in _sets(b, 5, 6, width):
                key, rep = (cols[0][i], cols[1][i], cols[2][i]), cols[3][i]
                if key != unit:
                    if rows:
                        yield done()
                    unit, rows = key, []
                if not rows or rows[-1][0] != rep:
                    rows.append((rep, cols[4][i], h))
        if rows:
            yield done()

    size = lists.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.sum(F.greatest(F.lit(1.0), F.col("n") / 1000)) / block).cast("int").alias("blocks")).where("lo < hi")
    dealt = lists.join(size.select("hub", "blocks"), "hub").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("hub", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "rep", "comp")
    rows = units.join(texts, "rep").select("hub", "u", "v", "rep", "comp", "text", "digest")
    return rows.repartition("hub", "u", "v").sortWithinPartitions("hub", "u", "v", "rep").mapInArrow(run, "hub long, rep long")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: tuple[int, int] = LEAST, width: int = WIDTH, fragment: int = FRAGMENT, dealt: int = DEALT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach, its own included).

    A document's set has its different ``width``-word shingles, with A-Z in lower case; one of fewer words has
    all of them as one shingle, one without words or text an empty set, which links nothing. Rows whose sets are equal or
    similar are linked; rows that share an id count each by their own text. A row with a null id links nothing and
    has a null component. An empty table gives no rows.
    """
    if not 0 < least[0] < least[1]:
        raise ValueError("the least similarity lies between 0 and 1")
    cuts = Cuts(least)
    narrow = staged(signed(docs, id_col, text_col, width), "ngram-documents")
    reps = narrow.where("doc_id IS NOT NULL AND n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"))
    reps = staged(reps.withColumn("rep", F.monotonically_increasing_id()), "ngram-sets")
    own = reps.select("digest", F.col("first_id").alias("doc_id"), "rep")
    keyed = signed(docs, id_col, text_col, width, cuts).where("doc_id IS NOT NULL AND length(keys) > 0").join(own, ["digest", "doc_id"])
    sizes = reps.select("rep", "n")
    found = stars(keyed).join(sizes.withColumnRenamed("n", "n_rep"), "rep").join(sizes.select(F.col("rep").alias("hub"), F.col("n").alias("n_hub")), "hub")
    found = staged(found, "ngram-stars")
    able = F.greatest("n_hub", "n_rep") <= F.floor(F.least("n_hub", "n_rep") * least[1] / least[0])
    some = found.select("rep").union(found.select("hub")).distinct().join(own, "rep")
    texts = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(some, "doc_id").select("rep", "digest", "text"), "ngram-texts")

    best = found.where(able).groupBy("rep").agg(F.max_by(F.struct("hub", "n_hub", "n_rep"), F.struct("shared", -F.col("hub"))).alias("b")).select("rep", "b.*")
    links = staged(overlaps(best, texts, least, width, fragment, dealt), "ngram-links")

    comp = staged(components(links.select(F.col("hub").alias("a"), F.col("rep").alias("b"))), "ngram-components")
    of = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    now = found.join(best.select("rep", F.col("hub").alias("first_hub")), "rep", "left").join(of("rep"), "rep", "left").join(of("hub"), "hub", "left")
    now = now.select("hub", "n_hub", F.coalesce("comp_hub", "hub").alias("comp_hub"), "rep", "n_rep", F.coalesce("comp_rep", "rep").alias("comp_rep"), F.coalesce(F.col("first_hub") == F.col("hub"), F.lit(False)).alias("seen"))
    now = staged(now, "ngram-placed")
    # a hub with one other set that it has been compared with has nothing left
    alone = now.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.max("seen").alias("seen")).where("members = 1 AND seen").select("hub")
    lists = now.select("hub", "rep", F.col("comp_rep").alias("comp"), F.col("n_rep").alias("n")).unionByName(now.select("hub", F.col("hub").alias("rep"), F.col("comp_hub").alias("comp"), F.col("n_hub").alias("n")).distinct())
    rest = left_over(lists.join(alone, "hub", "left_anti"), texts, least, width, block)
    links = staged(links.unionByName(rest), "ngram-links")
    unstage(now, texts, found, comp)
    comp = staged(components(links.select(F.col("hub").alias("a"), F.col("rep").alias("b"))), "ngram-components")
    sets = reps.join(comp, reps["rep"] == comp["node"], "left").select("digest", "first_id", F.coalesce("comp", "rep").alias("comp"))
    lowest = sets.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_set = sets.join(lowest, "comp").select("digest", "component_id")
    out = narrow.join(of_set, "digest", "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))


_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i : i + {WIDTH} - 1], ' ')) END) AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
f AS (SELECT x, count(*) AS c FROM e GROUP BY x HAVING count(*) > 1),
r AS MATERIALIZED (SELECT doc_id, n, e.x, row_number() OVER (PARTITION BY doc_id ORDER BY c, e.x) + n - count(*) OVER (PARTITION BY doc_id) AS place FROM e JOIN f USING (x)),
p AS (SELECT * FROM r WHERE 100 * (n - place + 1) >= {LEAST[0]} * n),
k AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {LEAST[0]} * greatest(a.n, b.n)),
o AS (SELECT k.a, k.b, k.na, k.nb, count(*) AS i FROM k JOIN r u ON u.doc_id = k.a JOIN r v ON v.doc_id = k.b AND v.x = u.x GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * i >= {LEAST[0]} * (na + nb - i)),
both_ways AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(doc_id, other) AS (SELECT a, a FROM both_ways UNION SELECT c.doc_id, w.b FROM c JOIN both_ways w ON c.other = w.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(other) AS component_id FROM c GROUP BY doc_id) m USING (doc_id)"""

QUERIES = {"op12_ngram_join": op12}
ORACLES: dict[str, str] = {"op12_ngram_join": _SQL}
