"""Near-duplicates by BagMinHash signatures, banding, and a check of the multiset overlap.

A text is the multiset of its windows of five words; two texts are near when the sum of the smaller
multiplicities over the sum of the larger ones (weighted Jaccard) is 0.8 or more.

BagMinHash: each window owns a hierarchy of Poisson processes, one over each dyadic block of weights
[0, 1), [1, 2), [2, 4), [4, 8), ...: a point has a time, a signature slot and a weight, and it counts in a
text whose multiplicity exceeds its weight. A slot keeps the earliest time, so two texts agree in a slot
with a probability equal to their weighted Jaccard similarity. Only points that can still change a
signature are made, which for long texts is fewer than one per window.

Bands of slots name buckets. In a bucket every text is compared with its hub, the text that shares most
buckets with others. Two other texts of a bucket matter only if they are still in different components,
and then they can be near only if their common part with the hub is large enough by itself or if they
share windows that the hub lacks. The texts of a hub that can take part in such a pair meet once, with
their text, in blocks; a task leaves out pairs by their sizes and by how much of each stretch of the hub
they hold, compares the others until they are linked, and gives links only. So no link between different
texts of a bucket is lost, no pairs are shuffled, and a group of copies does not cost the square of its size.
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
from larkspur.llm.exact_dedup import normalised
from larkspur.llm.shared import SPACE, documents, staged, unstage

WIDTH = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
#: Windows known to be frequent, at most; see ``frequent_windows``.
FREQUENT = 20_000
#: Stretches of a hub in which a text's part of it is counted, and texts of a hub that are compared with one another together, about.
SKETCH = 64
BLOCK = 500
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def multisets(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH, places: bool = False) -> tuple[np.ndarray, ...]:
    """Text number, window hash and multiplicity of every distinct window, and where it comes first if asked for; sorted by text and hash."""
    starts, ends, first = bv.words(buf, offsets)
    h, n = bv.window_hash(bv.spans_hash(buf, starts, ends), first, width)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc)) if len(n) < 2 else np.argsort(_with_doc(h, doc), kind="stable")
    if len(n) >= 2:  # sorted by 20 bits of the text's number and 44 of the hash: put the rest in order where it matters
        d, x = doc[order], h[order]
        if ((d[1:] == d[:-1]) & (x[1:] < x[:-1])).any() or (d[1:] < d[:-1]).any():
            order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    found = doc[at], h[at], np.diff(np.append(at, len(h)))
    if places:
        first = np.cumsum(n) - n
        return *found, np.minimum.reduceat(order, at) - first[doc[at]] if len(at) else at
    return found


def _with_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return doc.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """Earliest times per text and slot (n_docs x slots, float64); a text without elements has infinities.

    The processes of all elements and blocks run on together, each holding its next point. A text's points are
    taken up to a horizon: at first one that fits its total weight, from when all slots are filled on the
    latest time in its signature, since no later point can change it. Where a slot is still empty at the
    horizon, the processes of that text go on from where they stand.
    """
    out = np.full((n_docs, slots), np.inf)
    flat = out.reshape(-1)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    todo, reach = total > 0, np.log(slots) + 2.0
    running = []  # for each block: low and high weight; text, weight, key and time of the next point of each process
    block, low, high, d, e, w = 0, 0.0, 1.0, doc, element, weight.astype(np.float64)
    while len(d):  # elements whose weight reaches into this block
        key = bv.mix(bv.mix(e + np.uint64((block + 1) * int(bv.GOLD) & 0xFFFFFFFFFFFFFFFF)) + _STEP)
        running.append((low, high, d, w, key, -np.log(_unit(key)) / (slots * (high - low))))
        block, low, high = block + 1, high, high * 2
        up = w > low
        d, e, w = d[up], e[up], w[up]
    while todo.any():
        horizon = np.where(todo, reach / np.maximum(total, 1.0), 0.0)
        for low, high, d, w, key, time in running:
            on = np.flatnonzero(time < horizon[d])
            n_d, n_w, n_key, n_time, turn = d[on], w[on], key[on], time[on], 0
            while len(on):
                more = bv.mix(n_key ^ bv.GOLD)
                at = n_d * slots + (more >> np.uint64(40)).astype(np.int64) % slots
                if low == 0:
                    np.minimum.at(flat, at, n_time)
                else:
                    inside = low + _unit(bv.mix(more)) * (high - low) < n_w
                    np.minimum.at(flat, at[inside], n_time[inside])
                turn += 1
                if turn & (turn - 1) == 0:  # the latest times are looked up ever less often
                    horizon = np.minimum(horizon, out.max(axis=1))
                n_key = bv.mix(n_key + _STEP)
                n_time = n_time - np.log(_unit(n_key)) / (slots * (high - low))
                key[on], time[on] = n_key, n_time
                go = n_time < horizon[n_d]
                on, n_d, n_w, n_key, n_time = on[go], n_d[go], n_w[go], n_key[go], n_time[go]
        todo &= np.isinf(out).any(axis=1)
        reach *= 1.4
        running = [(low, high, *(x[todo[d]] for x in (d, w, key, time))) for low, high, d, w, key, time in running] if todo.any() else []
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per text and band."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(bv.mix(np.arange(1, bands + 1, dtype=np.uint64) * bv.GOLD), bits.shape[:2])
    for r in range(rows):
        key = bv.mix(key * np.uint64(0xD1342543DE82EF95) + bits[:, :, r])
    return key.view(np.int64)


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, digest (of the words), bands (array of keys, empty for a text without words)."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi, buf, offsets in bv.chunks(texts):
                doc, element, weight = multisets(buf, offsets, width)
                sig = signatures(doc, element, weight, hi - lo, bands * rows)
                empty = np.isinf(sig[:, 0])
                keys = band_keys(sig, bands, rows)
                counts = np.where(empty, 0, bands)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(keys[~empty].ravel()))
                raw = buf.tobytes()
                digest = [hashlib.sha256(normalised(raw[a:b]).strip(b" ")).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(digest, pa.binary()), lists], names=["doc_id", "digest", "bands"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def overlaps(a: pa.Array, b: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Weighted Jaccard similarity of the pairs of two columns of texts."""
    out = np.zeros(len(a))
    step = 512
    for lo in range(0, len(a), step):
        both = pa.concat_arrays([a.slice(lo, step).cast(pa.large_binary()), b.slice(lo, step).cast(pa.large_binary())])
        n = len(both) // 2
        parts = [multisets(buf, off, width) + (first,) for first, _, buf, off in bv.chunks(both)]
        doc = np.concatenate([d + first for d, _, _, first in parts])
        h, w = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        total = np.bincount(doc, weights=w, minlength=2 * n)
        pair = doc % n
        order = np.lexsort((h, pair))
        pair, h, w = pair[order], h[order], w[order]
        same = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
        common = np.bincount(pair[1:][same], weights=np.minimum(w[1:], w[:-1])[same], minlength=n)
        union = total[:n] + total[n:] - common
        out[lo : lo + n] = np.where(union > 0, common / np.maximum(union, 1), 0.0)
    return out


def frequent_windows(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes of the windows that most texts share, sorted; at most FREQUENT.

    They only order a search, so that it meets rare windows first; results do not depend on them.
    """

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in bv.chunks(batch.column(0)):
                h, n = np.unique(multisets(buf, offsets, width)[1], return_counts=True)
                many = n >= max(3, (hi - lo) // 400)
                yield pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(n[many])], names=["h", "n"])

    found = texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT)
    return np.sort(np.array([r.h for r in found.collect()], np.int64)).view(np.uint64)


def compare_with_hub(a: pa.Array, b: pa.Array, similarity: float, width: int, late: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """For pairs of hub and text: similarity, overlap, the text's weight, a prefix of what it has beyond the hub, and its sketch.

    A text near this one overlaps it by at least ``similarity`` times its weight, and all but the overlap
    with the hub lies in what is beyond the hub. Of two such sets, in one order (windows in ``late`` last,
    then by hash), the first few elements must meet: as many as are more than what may be missing.
    The sketch is how much of the overlap lies in each of SKETCH equal stretches of the hub.
    """
    n = len(a)
    parts = [multisets(buf, off, width, True) + (first,) for first, _, buf, off in bv.chunks(pa.concat_arrays([a.cast(pa.large_binary()), b.cast(pa.large_binary())]))]
    doc = np.concatenate([p[0] + p[4] for p in parts])
    h, w, place = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    total = np.bincount(doc, weights=w, minlength=2 * n)
    order = np.lexsort((doc >= n, h, doc % n))
    doc, h, w, place = doc[order], h[order], w[order], place[order]
    pair = doc % n
    same = np.zeros(len(h), bool)
    same[1:] = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
    before = np.where(same, np.concatenate([[0], w[:-1]]), 0)
    both = np.minimum(w, before)
    common = np.bincount(pair, weights=both, minlength=n)
    union = total[:n] + total[n:] - common
    stretch = np.concatenate([[0], place[:-1]]) * SKETCH // np.maximum(total[pair], 1).astype(np.int64)
    sketch = np.bincount((pair * SKETCH + np.minimum(stretch, SKETCH - 1))[same], weights=both[same], minlength=n * SKETCH).reshape(n, SKETCH)
    extra = np.where(doc >= n, np.maximum(w - before, 0), 0)
    at = bv.ranges(np.zeros(len(extra), np.int64), extra)
    who = np.repeat(pair, extra)
    of = np.repeat(h, extra)
    key = bv.mix(of + at.astype(np.uint64) * bv.GOLD)
    order = np.lexsort((key, np.isin(of, late), who))
    who, key = who[order], key[order]
    bounds = np.searchsorted(who, np.arange(n + 1))
    size = np.diff(bounds)
    must = np.maximum(1, np.ceil(similarity * total[n:] - common - 1e-9)).astype(np.int64)
    take = np.maximum(0, size - must + 1)
    return common / np.maximum(union, 1), common, total[n:], [key[i : i + k].view(np.int64) for i, k in zip(bounds[:-1], take)], sketch


def stars_verified(pairs: DataFrame, texts: DataFrame, similarity: float, width: int, late: np.ndarray) -> DataFrame:
    """a (hub), b, near, common, weight, beyond (array of hashes), sketch (32-bit counts) for each pair of hub and text.

    Joins with texts are merge joins at every size: how many pairs there are is not bounded, so none is broadcast.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                own = batch.slice(lo, 512)
                sim, common, weight, beyond, sketch = compare_with_hub(own.column(2), own.column(3), similarity, width, late)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in beyond])]).astype(np.int32)), pa.array(np.concatenate(beyond)))
                counts = pa.array([x.tobytes() for x in sketch.astype("<i4")], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(sim >= similarity - 1e-12), pa.array(common), pa.array(weight), lists, counts], names=["a", "b", "near", "common", "weight", "beyond", "sketch"])

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("b_text"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long, near boolean, common double, weight double, beyond array<long>, sketch binary")


class Group:
    """Texts of one hub, or of two of its blocks: what is needed to find the links among those in different components."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids, comp, self.common, self.weight, inside, self.block, shared, sketch, self.texts = zip(*rows)
        self.comp, self.inside = np.array(comp), np.array(inside)
        self.common, self.weight = np.array(self.common), np.array(self.weight)
        self.sketch = np.frombuffer(b"".join(sketch), "<i4").reshape(len(rows), SKETCH)
        self.where: dict[int, list[int]] = {}
        for i, some in enumerate(shared):
            for s in some or ():
                self.where.setdefault(s, []).append(i)

    def candidates(self, similarity: float) -> Iterator[tuple[int, int]]:
        """Pairs that sizes, stretches and shared windows beyond the hub leave."""
        least, n = similarity / (1 + similarity), len(self.ids)
        block = np.array(self.block)
        meet = np.zeros((n, n), bool)
        meet[np.ix_(self.inside, self.inside)] = True
        for own in self.where.values():
            meet[np.ix_(own, own)] = True
        beyond = self.weight - self.common
        for i in range(n):
            # with two blocks, pairs within one of them are another unit's
            j = np.flatnonzero(meet[i, i + 1 :] & (self.comp[i + 1 :] != self.comp[i]) & ((block[i + 1 :] != block[i]) | (block[0] == block[-1]))) + i + 1
            need = least * (self.weight[i] + self.weight[j]) - 1e-9
            j = j[np.minimum(self.common[i], self.common[j]) + np.minimum(beyond[i], beyond[j]) >= need]
            if len(j):
                need = least * (self.weight[i] + self.weight[j]) - 1e-9
                most = np.minimum(self.sketch[i], self.sketch[j]).sum(1) + np.minimum(beyond[i], beyond[j])
                for k in j[most >= need].tolist():
                    yield i, k

    def links(self, similarity: float, width: int) -> Iterator[tuple[int, int]]:
        """Pairs of ids that are near, as many as join their components."""
        top = {c: c for c in self.comp.tolist()}
        bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def find(c):
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        def bag(i):
            if i not in bags:
                ((_, _, buf, off),) = bv.chunks(pa.array([self.texts[i]], pa.large_binary()))
                bags[i] = multisets(buf, off, width)[1:]
            return bags[i]

        for i, j in self.candidates(similarity):
            p, q = find(int(self.comp[i])), find(int(self.comp[j]))
            if p == q:
                continue
            (h, w), (g, v) = bag(i), bag(j)
            _, x, y = np.intersect1d(h, g, assume_unique=True, return_indices=True)
            common = np.minimum(w[x], v[y]).sum()
            if common >= (similarity - 1e-12) * (w.sum() + v.sum() - common):
                top[max(p, q)] = min(p, q)
                yield self.ids[i], self.ids[j]


def linked(members: DataFrame, similarity: float, width: int) -> DataFrame:
    """a, b: links among the members of each unit (a hub, u, v: two of its blocks), by texts. See ``Group``."""

    def run(batches):
        now, rows = None, []

        def done():
            found = list(Group(rows).links(similarity, width))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for unit, row in zip(zip(*cols[:3]), zip(*cols[3:])):
                if unit != now and rows:
                    yield done()
                    rows = []
                now = unit
                rows.append(row)
        if rows:
            yield done()

    cols = ["b", "comp", "common", "weight", "inside", "block", "shared", "sketch", "text"]
    return members.select("a", "u", "v", *cols).repartition("a", "u", "v").sortWithinPartitions("a", "u", "v", "block", "b").mapInArrow(run, "a long, b long")


def _classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """doc_id, digest (of the words), class_id and kept for every row; see ``near_groups``."""
    signed = staged(sign(docs, id_col, text_col, bands, rows, width), "near-signatures")
    reps = staged(signed.where("doc_id IS NOT NULL AND size(bands) > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")), "near-texts")
    in_bucket = reps.select(F.explode("bands").alias("key"), "rep")
    shared = in_bucket.groupBy("key").agg(F.count("rep").alias("size")).where("size > 1")
    members = staged(in_bucket.join(shared, "key"), "near-buckets")
    central = members.groupBy("rep").agg(F.sum("size").alias("reach"))
    hubs = members.select("key", "rep").join(central, "rep").groupBy("key").agg(F.max_by("rep", F.struct(F.col("reach"), -F.col("rep"))).alias("hub"))
    stars = members.select("key", "rep").join(hubs, "key").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    texts = staged(docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(central.select("rep").hint("merge"), "rep", "left_semi"), "near-candidates")
    first = staged(stars_verified(stars, texts, similarity, width, frequent_windows(texts, width)), "near-stars")
    comp = staged(components(first.where("near").select("a", "b")), "near-components")
    placed = first.join(comp, first["b"] == comp["node"], "left").select("a", "b", "near", "common", "weight", "beyond", "sketch", F.coalesce("comp", "b").alias("comp"))
    placed = staged(placed, "near-placed")
    # the hub's part alone can make two texts near only where it is most of both; else they share windows beyond it
    inside = F.col("common") >= similarity * F.col("weight") - 1e-9
    beyond = placed.select("a", "b", "comp", F.explode("beyond").alias("s"))
    mixed = beyond.groupBy("a", "s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("a", "s")
    sharing = beyond.join(mixed, ["a", "s"]).groupBy("a", "b").agg(F.collect_set("s").alias("shared"))
    able = placed.drop("beyond").withColumn("inside", inside).join(sharing, ["a", "b"], "left").where("inside OR shared IS NOT NULL")
    able = staged(able, "near-members")
    # blocks of a hub, those of texts that are not near it first: a unit for each two blocks, so that no task holds all
    # texts of a hub; texts near the hub are linked already and meet the others only
    size = able.groupBy("a").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *(F.sum(F.when(w, F.greatest(F.lit(1.0), F.col("weight") / 1000))).alias(c) for c, w in (("far", ~F.col("near")), ("close", F.col("near"))))).where("lo < hi")
    count = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(0.0)) / block).cast("int")
    dealt = able.join(size.select("a", count("far").alias("n_far"), count("close").alias("n_close")), "a")
    of_block = lambda n: F.pmod(F.xxhash64("b"), n).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("near"), F.col("n_far") + of_block("n_close")).otherwise(of_block("n_far")))
    others = F.sequence(F.lit(0), F.col("n_far") - 1 + F.when(F.col("near"), 0).otherwise(F.col("n_close")))
    units = dealt.withColumn("other", F.explode(others)).select("*", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"))
    second = linked(units.join(texts.withColumnRenamed("rep", "b").hint("merge"), "b"), similarity, width)
    links = staged(second.unionByName(comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))), "near-links")
    unstage(members, texts, first, comp, placed, able)
    final = components(links)
    unstage(links)
    classes = reps.select("digest", "rep").join(final, reps["rep"] == final["node"], "left").select("digest", F.coalesce("comp", "rep").alias("class"))
    # equal texts share a digest: the smallest id stands for them on one row, so only hot digests are wide
    joined = signed.select("doc_id", "digest", F.size("bands").alias("n")).join(classes, "digest", "left")
    class_id = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class"))
    return joined.select("doc_id", "digest", class_id.alias("class_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest id of its class), kept (it is that one).

    Null text counts as empty; a text without words is near no other, and one of fewer than ``width``
    words is one window. Equal texts are one class. Rows with a null id have a null class and link nothing;
    rows that share an id are one document. Links are transitive. A pair at the threshold is missed by all
    bands with probability (1 - 0.8**5)**25 = 5e-5. An empty table gives no rows.
    """
    return _classes(docs, id_col, text_col, **options).select("doc_id", "class_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, columns as they were.

    A row goes by its id and its words together: another row of the same id with a text of its own stays. Rows with a null id stay.
    """
    gone = _classes(docs, id_col, text_col, **options).where("NOT kept").select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone_digest")).distinct()
    words = F.trim(F.regexp_replace(F.coalesce(docs[f"`{text_col}`"], F.lit("")), SPACE, " "))
    same = (docs[f"`{id_col}`"] == gone["_gone_id"]) & (F.unhex(F.sha2(words, 256)) == gone["_gone_digest"])
    return docs.join(gone.hint("merge"), same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


QUERIES = {"op4_bagminhash": op4}
ORACLES: dict[str, str] = {}
