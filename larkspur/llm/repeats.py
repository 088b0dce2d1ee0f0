"""Removal of byte strings that another document had first, by a column-wise suffix index.

A window is a string of 50 bytes inside one document. Windows are grouped so that equal ones always
meet: a window's anchor is the smallest hash among its 24-byte grams, and a piece is a run of windows of
one anchor. Anchors that a single text has cannot mark a repeat and are dropped before any text moves.
The pieces of an anchor go to one task. Equal ones are collapsed, and windows that no other piece has are
left out: equal windows have equal hashes, so a hash that comes once excludes its window and decides
nothing else. The suffixes of all that is left are sorted together the column-wise way: round j inserts,
for every piece, the symbol j places from its end, at the rank that the Burrows-Wheeler transform so far
gives it, and updates the common prefixes of the new suffixes and their successors. Each round reads the
round before it from front to back and writes its successor. Suffixes whose common prefix is 50 bytes or
more are one class, whose smallest document keeps the bytes.

An anchor of very many texts is split by further anchors (the smallest values of other hashes of the same
grams) until few different pieces share all of them, and its pieces are combined before they are shuffled;
the same index sorts them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bytes_view as bv
from larkspur.llm.shared import documents, staged

#: Bytes of a repeat, and of a gram that can be an anchor.
LENGTH = 50
GRAM = 24
#: Windows in a piece at most, so that rounds are bounded; an anchor that comes once is in 27 windows.
WINDOWS = LENGTH - GRAM + 1
#: Bytes of text whose anchors are found together; a longer text makes a chunk of its own.
SCAN_BYTES = 1_000_000
#: Pieces indexed together, about; documents cut together.
BLOCK = 2_000
ROWS = 1_500
#: Texts of one anchor, and different pieces of a split one, from which on it is split (further).
HOT = 200_000
#: Anchors of a piece at most; beyond, each window is a piece of its own.
LEVELS = 8
#: Tasks over which the copies of one text are dealt where their spans are made.
SALTS = 32
_LAST = np.iinfo(np.int64).max  # the order of a null id


def n_bits(total: int) -> int:
    """Bits of an anchor that name its bucket, for so many bytes of text.

    A bucket holds about a million anchors for half a GB and grows with the fourth root of the input, so that
    neither buckets nor the blobs that tasks pack for each of them get out of hand: 10 bits for 30 GB, 19 for 100 TB.
    """
    n = total / 14 + 1
    return max(4, int(np.ceil(np.log2(n / (1e6 * max(1.0, n / 36e6) ** 0.25)))))


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, windows: int = WINDOWS, level: int = 0):
    """Row, start, number of windows and anchor of each piece; each ``level`` hashes the grams anew."""
    sizes = np.diff(offsets)
    n_win = np.maximum(sizes - length + 1, 0)
    at = bv.ranges(offsets[:-1], n_win)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    n = len(buf)
    starts = np.arange(n - gram + 1)
    m = bv.spans_hash(buf, starts, starts + gram)
    if level:
        m = bv.mix(m + np.uint64(level) * bv.GOLD)
    width, span = 1, length - gram + 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    m = m[at]
    new = np.ones(len(at), bool)
    new[1:] = (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)
    new[np.cumsum(n_win) [:-1][np.diff(np.cumsum(n_win)) > 0]] = True
    runs = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))
    cut = np.flatnonzero(within % windows == 0)
    row = np.repeat(np.arange(len(sizes)), n_win)[cut]
    return row, at[cut] - offsets[row], np.diff(np.append(cut, len(at))), bv.mix(m[cut])


def index(pieces: list[bytes], owner: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, the smallest owner of each of its windows among all pieces."""
    sizes = np.array([len(p) for p in pieces])
    return np.split(index_flat(np.frombuffer(b"".join(pieces), np.uint8), sizes, owner, length), np.cumsum(np.maximum(sizes - length + 1, 0))[:-1])


def index_flat(data: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The smallest owner of each window of pieces that lie one after the other in ``data``.

    ``rows`` of the transform are in the order of their suffixes; each has its piece and size, its common
    prefix with the suffix above (up to ``length``), and the symbol before it.
    """
    n = len(sizes)
    top = int(sizes.max())
    end_mark, kind = (255, np.uint8) if not (data == 255).any() else (256, np.uint16)
    ends = np.cumsum(sizes)
    # a row: piece, size of the suffix (16 bits), common prefix (8), symbol before (16)
    rows = np.arange(n) << 40 | data[ends - 1]
    fresh = np.ones(n, bool)
    for j in range(1, top + 1):
        bwt = rows.astype(kind)
        order = np.argsort(bwt, kind="stable")[: len(bwt) - np.count_nonzero(bwt == end_mark)]
        is_new = fresh[order]
        at = np.flatnonzero(is_new)
        piece = rows[order[at]] >> 40
        # common prefixes of the new suffixes and of those that follow them
        touched = is_new.copy()
        touched[1:] |= is_new[:-1]
        t = np.flatnonzero(touched)
        same = (bwt[order[t]] == bwt[order[t - 1]]) & (t > 0)
        value = np.zeros(len(t), np.int64)
        if same.any():
            lo, hi = order[t[same] - 1] + 1, order[t[same]]
            gap = hi - lo + 1
            lcp = (rows >> 16).astype(np.uint8)
            value[same] = np.minimum(np.minimum.reduceat(lcp[bv.ranges(lo, gap)], np.cumsum(gap) - gap), length - 1).astype(np.int64) + 1
        # write the next transform: old rows keep their order between the new ones
        more = j < sizes[piece]
        symbol = np.full(len(piece), end_mark)
        symbol[more] = data[ends[piece[more]] - 1 - j]
        fresh = np.zeros(len(rows) + len(at), bool)
        fresh[n + at] = True
        grown = np.empty(len(fresh), np.int64)
        grown[~fresh] = rows
        grown[n + at] = piece << 40 | j << 24 | symbol
        rows = grown
        rows[n + t] = (rows[n + t] & ~(0xFF << 16)) | value << 16
    who, lcp = rows >> 24, (rows >> 16) & 0xFF
    piece, size = who >> 16, who & 0xFFFF
    heads = np.flatnonzero(lcp < length)
    least = np.minimum.reduceat(owner[piece], heads)
    least = np.repeat(least, np.diff(np.append(heads, len(lcp))))
    whole = size >= length
    base = np.concatenate([[0], np.cumsum(np.maximum(sizes - length + 1, 0))])
    out = np.empty(base[-1], np.int64)
    out[base[piece[whole]] + sizes[piece[whole]] - size[whole]] = least[whole]
    return out


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans in order of their starts, of a buffer of any size."""
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        base = starts[lo]
        hi = int(np.searchsorted(starts, base + bv.CHUNK // 2, side="right"))
        out[lo:hi] = bv.spans_hash(buf[base : ends[lo:hi].max()], starts[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return out


def digests(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first 64 bits of each text's SHA-256, which tell the texts of one anchor apart."""
    raw = memoryview(np.ascontiguousarray(buf))
    return np.frombuffer(b"".join(hashlib.sha256(raw[a:b]).digest()[:8] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.uint64)


def distinct(anchor: np.ndarray, content: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal anchor and content hash: the number of the one with the smallest owner, by anchor, and each row's place in that list."""
    order = np.lexsort((owner, content, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def least_owners(data: np.ndarray, sizes: np.ndarray, anchor: np.ndarray, owner: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The smallest owner of each window of different pieces, given by anchor; and which pieces share a window with another."""
    n_win = sizes - length + 1
    least, first, start = np.repeat(owner, n_win), np.cumsum(n_win) - n_win, np.cumsum(sizes) - sizes
    mixed = np.zeros(len(sizes), bool)
    several = np.zeros(len(sizes), bool)  # a collection of one piece has nothing to sort
    several[1:] = anchor[1:] == anchor[:-1]
    several[:-1] |= several[1:]
    todo = np.flatnonzero(several)
    w_piece, w_at = np.repeat(todo, n_win[todo]), bv.ranges(start[todo], n_win[todo])
    h = hashes(data, w_at, w_at + length)
    order = np.argsort(h)
    h = h[order]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[:-1] |= again[1:]
    shared = np.zeros(len(h), bool)
    shared[order] = again
    w = np.flatnonzero(shared)
    if not len(w):
        return least, mixed
    # runs of shared windows, and the different ones among them
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1] + 1) | (w_piece[w][1:] != w_piece[w][:-1])
    a = np.flatnonzero(new)
    run, n = w[a], np.diff(np.append(a, len(w)))
    piece, lo, size = w_piece[run], w_at[run], n + length - 1
    mixed[piece] = True
    some, of = distinct(anchor[piece], hashes(data, lo, lo + size), owner[piece])
    s_size, s_anchor, s_owner = size[some], anchor[piece[some]], owner[piece[some]]
    s_win = n[some]
    s_least, s_first = np.repeat(s_owner, s_win), np.cumsum(s_win) - s_win
    several = np.zeros(len(some), bool)
    several[1:] = s_anchor[1:] == s_anchor[:-1]
    several[:-1] |= several[1:]
    todo = np.flatnonzero(several)
    while len(todo):
        upto = int(np.searchsorted(s_anchor[todo], s_anchor[todo[min(block, len(todo)) - 1]], side="right"))
        t = todo[:upto]
        s_least[bv.ranges(s_first[t], s_win[t])] = index_flat(data[bv.ranges(lo[some[t]], s_size[t])], s_size[t], s_owner[t], length)
        todo = todo[upto:]
    least[first[w_piece[w]] + w_at[w] - start[w_piece[w]]] = s_least[bv.ranges(s_first[of], n)]
    return least, mixed


def _pack(*columns: np.ndarray, raw: bytes = b"") -> bytes:
    """Columns of equal length, and bytes after them, in one compressed string for the way."""
    import zstandard

    head = ",".join(c.dtype.str for c in columns).encode()
    parts = [c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in map(np.ascontiguousarray, columns)]  # bytes of one rank side by side
    return len(columns[0]).to_bytes(4, "little") + len(head).to_bytes(2, "little") + head + zstandard.compress(b"".join(parts) + raw, 3)


def _unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    import zstandard

    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:6], "little")
    data, at, out = zstandard.decompress(blob[6 + size :]), 0, []
    for kind in blob[6 : 6 + size].decode().split(","):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind)[:, 0])
        at += n * width
    return out, data[at:]


def _by_bucket(bucket: np.ndarray):
    """(bucket, numbers of its rows) for each bucket."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return [(int(bucket[order[i]]), order[i:j]) for i, j in zip(cuts, np.append(cuts[1:], len(order)))]


def _buckets(batches):
    """(bucket, its blobs) from rows (bucket, blob) sorted by bucket."""
    now, held = None, []
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield now, held


def _zip(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key (of id and text, for tables that repeat an id), and the text compressed for the way."""

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array([z.compress(t) for t in b.column(2).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "row_key", "z"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("row_key"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, z binary")


def _gather(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*columns)]


def pack_anchors(rows: list[list[np.ndarray]], bits: int) -> pa.RecordBatch:
    """Places (anchor, start, windows, document, text hash) of some text, packed by bucket.

    An anchor that several of these texts have is known to be shared: its places go along as they are, in a
    blob of a negative bucket, and its own bucket gets one witness (no windows; how many texts for a start). So a
    bucket holds an anchor as often as there are such packings at most, however many documents have it.
    """
    h, start, n, ids, whole = _gather(rows)
    key = (h & np.uint64(0xFFFFFFFFFF)).astype(np.int64) | (h >> np.uint64(64 - bits)).astype(np.int64) << 40
    order = np.lexsort((whole, key))
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    texts = new.copy()
    texts[1:] |= whole[order][1:] != whole[order][:-1]
    heads = np.flatnonzero(new)
    count = np.add.reduceat(texts, heads, dtype=np.int64)
    known = np.empty(len(key), bool)
    known[order] = (count > 1)[np.cumsum(new) - 1]
    sure, own = np.flatnonzero(known), np.flatnonzero(~known)
    seen = order[heads[count > 1]]
    zero = np.zeros(len(seen), np.int64)
    out = [_places_blob(-1 - int(key[sure[0]] & 0xFFFF), key[sure], start[sure], n[sure], ids[sure], whole[sure])] if len(sure) else []
    key, start, n = np.concatenate([key[own], key[seen]]), np.concatenate([start[own], count[count > 1]]), np.concatenate([n[own], zero])
    ids, whole = np.concatenate([ids[own], zero]), np.concatenate([whole[own], zero.astype(np.uint64)])
    out += [_places_blob(bucket, *(x[i] for x in (key, start, n, ids, whole))) for bucket, i in _by_bucket((key >> 40).astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "blob"])


def _places_blob(bucket: int, key: np.ndarray, start: np.ndarray, n: np.ndarray, ids: np.ndarray, whole: np.ndarray) -> tuple[int, bytes]:
    """Texts once where their places follow one another; of a bucket's own anchors 40 bits, else all 64."""
    new = np.ones(len(key), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (whole[1:] != whole[:-1])
    texts = _pack(ids[new], whole[new])
    low = np.ascontiguousarray(key.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : 5 if bucket >= 0 else 8]).tobytes()
    return bucket, len(texts).to_bytes(4, "little") + texts + _pack(new.astype(np.int8), start.astype(np.int32), n.astype(np.int8), raw=low)


def _read_places(bucket: int, blob: bytes) -> tuple[np.ndarray, ...]:
    """Anchor, text hash, document, start and windows of each place of a blob."""
    cut = 4 + int.from_bytes(blob[:4], "little")
    (ids, whole), _ = _unpack(blob[4:cut])
    (new, start, n), low = _unpack(blob[cut:])
    width = 5 if bucket >= 0 else 8
    key = np.zeros((len(n), 8), np.uint8)
    key[:, :width] = np.frombuffer(low, np.uint8).reshape(-1, width)
    at = np.cumsum(new, dtype=np.int64) - 1
    return key.view("<i8")[:, 0] | (max(bucket, 0) << 40), whole[at], ids[at], start, n


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, row_key, spans (array of lo, hi byte offsets, may overlap) for documents with repeats.

    Equal texts go through the index as one, owned by their smallest id; its later copies are repeats from
    end to end. ``length`` is at most 255.
    """
    if not 1 <= length <= 255:
        raise ValueError(f"common prefixes are kept in a byte: length {length} is not within 1 to 255")
    gram = min(GRAM, max(1, length // 2))
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = n_bits(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    tasks = 1 << bits

    def scan(batches):
        rows, count = [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, buf, offsets in bv.chunks(b.column(1), SCAN_BYTES):
                whole, own = digests(buf, offsets), ids[lo:hi]
                # of equal texts in a chunk the first document will do
                first = np.zeros(hi - lo, bool)
                first[distinct(np.zeros(hi - lo, np.int8), whole, own)[0]] = True
                row, start, n, h = anchors(buf, offsets, length, gram)
                keep = first[row]
                row = row[keep]
                rows.append((h[keep], start[keep], n[keep], own[row], whole[row]))
                count += len(row)
                if count >= min(1024 << bits, 4_000_000):
                    yield pack_anchors(rows, bits)
                    rows, count = [], 0
        if count:
            yield pack_anchors(rows, bits)

    def shared(batches):
        """Places (kind 0) of anchors that more than one text has, of each text those of its first document; and anchors (kind 1) of very many texts."""

        def batch(doc, start, n, h, kind):
            cols = (doc, start.astype(np.int32), n.astype(np.int8), h, np.full(len(h), kind, np.int8))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["doc_id", "start", "n", "h", "kind"])

        for bucket, held in _buckets(batches):
            if bucket < 0:
                for blob in held:
                    h, _, doc, start, n = _read_places(bucket, blob)
                    yield batch(doc, start, n, h, 0)
                continue
            h, whole, doc, start, n = _gather([_read_places(bucket, blob) for blob in held])
            order = np.lexsort((doc, whole, h))
            h, whole, doc, start, n = (x[order] for x in (h, whole, doc, start, n))
            new_h = np.diff(h, prepend=h[0] ^ 1) != 0
            new_text = new_h.copy()
            new_text[1:] |= whole[1:] != whole[:-1]
            first, heads = np.flatnonzero(new_text)[np.cumsum(new_text) - 1], np.flatnonzero(new_h)
            texts = np.add.reduceat(np.where(n == 0, start, new_text), heads)
            keep = (n > 0) & (texts > 1)[np.cumsum(new_h) - 1] & (doc == doc[first])
            yield batch(doc[keep], start[keep], n[keep], h[keep], 0)
            wide = heads[(texts > 1) & (texts > hot)]
            yield batch(doc[wide], start[wide], n[wide], h[wide], 1)

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), text.cast("binary").alias("text"))
    packed = rows.mapInArrow(scan, "bucket int, blob binary")
    marked = staged(packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(shared, "doc_id long, start int, n tinyint, h long, kind tinyint"), "repeat-anchors")
    live, wide = marked.where("kind = 0"), marked.where("kind = 1").select("h")

    def with_places(some):
        places = some.groupBy(F.col("doc_id").alias("d")).agg(F.collect_set(F.struct("start", "n", "h")).alias("places"))
        whole = _zip(docs, id_col, text_col)
        return whole.join(places, whole["doc_id"] == places["d"]).select("doc_id", "row_key", "z", "places")

    def read_places(batches):
        """For some documents at a time: id, row key, start, windows and anchor of each place, and its piece, one after the other."""
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for every in batches:
            for lo in range(0, every.num_rows, ROWS):
                b = every.slice(lo, ROWS)
                p = b.column(3)
                flat = p.flatten()
                row = np.repeat(np.arange(b.num_rows), np.diff(p.offsets.to_numpy()))
                start, n, h = (flat.field(k).to_numpy() for k in range(3))
                texts = [unzip.decompress(z) for z in b.column(2).to_pylist()]
                sizes = np.array([len(t) for t in texts], np.int64)
                own = start + n.astype(np.int64) + length - 1 <= sizes[row]  # where ids repeat, another row's place may lie outside
                row, start, n, h = row[own], start[own], n[own], h[own]
                buf = np.frombuffer(b"".join(texts), np.uint8)
                size = n.astype(np.int64) + length - 1
                yield b.column(0).to_numpy()[row], b.column(1).to_numpy()[row], start, n, h, (buf, (np.cumsum(sizes) - sizes)[row] + start, size)

    def pack_pieces(parts: list) -> pa.RecordBatch:
        """For each bucket the different pieces (anchor, windows, bytes) and, piece by piece, their places (id, row key, start, steps between pieces)."""
        doc, key, start, n, h, at, size = _gather([(*p[:5], *p[5][1:]) for p in parts])
        bufs = [p[5][0] for p in parts]
        at = at + np.repeat(np.cumsum([0] + [len(b) for b in bufs[:-1]]), [len(p[0]) for p in parts])
        buf = np.concatenate(bufs)
        order = np.argsort(at)
        content = np.empty(len(at), np.uint64)
        content[order] = hashes(buf, at[order], (at + size)[order])
        some, of = distinct(h, content, doc)
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(len(some) + 1))
        blobs_, names = [], (h[some] >> 38).astype(np.int32)  # in order, as anchors are
        heads = np.flatnonzero(np.diff(names, prepend=-1))
        for i, j in zip(heads, np.append(heads[1:], len(names))):
            own, places = some[i:j], order[bounds[i] : bounds[j]]
            pieces = _pack(h[own], n[own], raw=buf[bv.ranges(at[own], size[own])].tobytes())
            blobs_.append(len(pieces).to_bytes(4, "little") + pieces + _pack(doc[places], key[places], start[places], np.diff(of[places], prepend=i).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(names[heads]), pa.array(blobs_, pa.binary())], names=["bucket", "blob"])

    def cut(batches):
        parts, count, held = [], 0, 0
        for p in read_places(batches):
            parts.append(p)
            count, held = count + len(p[0]), held + len(p[5][0])
            if count >= min(1024 << bits, 500_000) or held > 32_000_000:
                yield pack_pieces(parts)
                parts, count, held = [], 0, 0
        if count:
            yield pack_pieces(parts)

    def solve(batches):
        for _, held in _buckets(batches):
            pieces, places, raws, count = [], [], [], 0
            for blob in held:
                cut_ = 4 + int.from_bytes(blob[:4], "little")
                own, raw = _unpack(blob[4:cut_])
                doc, key, start, step = _unpack(blob[cut_:])[0]
                of = np.cumsum(step, dtype=np.int64)
                places.append((doc, key, start, of + count))
                pieces.append((*own, np.minimum.reduceat(doc, np.searchsorted(of, np.arange(len(own[0]))))))
                raws.append(raw)
                count += len(own[0])
            h, n, owner = _gather(pieces)
            doc, key, start, at_piece = _gather(places)
            raw = np.frombuffer(b"".join(raws), np.uint8)
            size = n.astype(np.int64) + length - 1
            at = np.cumsum(size) - size
            # the different pieces of each anchor, with their smallest owner
            some, of = distinct(h, hashes(raw, at, at + size), owner)
            size, h, owner, of = size[some], h[some], owner[some], of[at_piece]
            least, mixed = least_owners(raw[bv.ranges(at[some], size)], size, h, owner, length)
            plain = np.flatnonzero(~mixed[of] & (owner[of] < doc))  # all windows are one owner's
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[plain], key[plain], start[plain].astype(np.int64), start[plain] + size[of[plain]])], names=["doc_id", "row_key", "lo", "hi"])
            part, windows = np.flatnonzero(mixed[of]), size - length + 1
            first = np.cumsum(windows) - windows
            row = np.repeat(part, windows[of[part]])
            place = bv.ranges(np.zeros(len(part), np.int64), windows[of[part]])
            hit = least[first[of[row]] + place] < doc[row]
            yield _spans(row[hit], (start[row] + place)[hit], doc, key, length)

    marks = "doc_id long, row_key long, lo long, hi long"
    some_wide = not wide.isEmpty()
    found = with_places(live.join(wide, "h", "left_anti") if some_wide else live).mapInArrow(cut, "bucket int, blob binary").repartition(2 * tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(solve, marks)
    if some_wide:
        found = found.unionByName(_split_spans(with_places(live.join(wide, "h", "left_semi")), read_places, length, gram, hot, tasks))
    # later copies of a whole text: all their windows are the first one's
    key, size = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), F.octet_length(text).cast("long")
    keys = staged(docs.select(key, F.xxhash64(F.col(id_col), text).alias("row_key"), F.sha2(text, 256).alias("same"), size.alias("hi")).where(F.col("hi") >= length), "repeat-texts")
    first = keys.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    dealt = first.select("same", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(SALTS)).cast("int")).join(dealt, ["same", "salt"]).where("doc_id > first")
    return found.unionByName(copies.select("doc_id", "row_key", F.lit(0).cast("long").alias("lo"), "hi")).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _split_spans(placed: DataFrame, read_places, length: int, gram: int, hot: int, tasks: int) -> DataFrame:
    """Spans (doc_id, row_key, lo, hi) of the pieces of hot anchors: split by further anchors, combined, sorted, joined back.

    A piece's key is its anchors so far. Keys with more than ``hot`` different pieces are split again by the
    next hash of the grams, and beyond LEVELS by each window itself, so no key stays large. What is shuffled by
    key are different pieces, combined where they are read; places only come in by a join on key and piece,
    which adaptive execution splits.
    """
    kind = "doc_id long, row_key long, lo long, k long, piece binary, fresh boolean"

    def sub(doc, key, lo, k, data, sizes, level):
        row, start, n, h = anchors(data, np.concatenate([[0], np.cumsum(sizes)]), length, gram, 1 if level > LEVELS else length - gram + 1, level)
        at = (np.cumsum(sizes) - sizes)[row] + start
        size = n + length - 1
        if level > LEVELS:
            h = hashes(data, at, at + size)
        k = bv.mix(k[row].astype(np.uint64) * bv.GOLD + h).view(np.int64)
        raw = data[bv.ranges(at, size)].tobytes()
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(key[row]), pa.array(lo[row] + start), pa.array(k), pieces, pa.array(np.ones(len(row), bool))], names=[c.split()[0] for c in kind.split(", ")])

    def split(batches):
        for doc, key, start, _, h, (buf, at, size) in read_places(batches):
            yield sub(doc, key, start.astype(np.int64), h, buf[bv.ranges(at, size)], size, 1)

    def again(level):
        def run(batches):
            for b in batches:
                pieces = b.column(4).cast(pa.large_binary())
                offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
                data = np.frombuffer(pieces.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                yield sub(*(b.column(i).to_numpy() for i in range(4)), data, np.diff(offsets), level)

        return run

    rows, level, over = staged(placed.mapInArrow(split, kind), "repeat-split"), 1, None
    while True:
        pieces = rows.where("fresh").groupBy("k", "piece").agg(F.min("doc_id").alias("owner"))
        wide = pieces.groupBy("k").agg(F.count("owner").alias("n"), F.max(F.octet_length("piece")).alias("size"))
        over = staged(wide.where((F.col("n") > hot) & (F.col("size") > length)).select("k"), "repeat-wide")
        if over.isEmpty():
            break
        level += 1
        deep = rows.where("fresh").join(over, "k", "left_semi").select("doc_id", "row_key", "lo", "k", "piece").mapInArrow(again(level), kind)
        rest = rows.join(over, "k", "left_anti").withColumn("fresh", F.lit(False))
        rows = staged(rest.unionByName(deep), "repeat-split")

    def sort(batches):
        """Runs of windows with one owner, by key; rows come sorted by key, and a key's pieces go together."""
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            k = held.column("k").to_numpy()
            done = int(np.searchsorted(k, k[-1])) if held.num_rows >= BLOCK else 0
            if done:
                yield runs(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield runs(held)

    def runs(t):
        pieces = t.column("piece").combine_chunks()
        pieces = (pieces if isinstance(pieces, pa.Array) else pa.concat_arrays(pieces.chunks)).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1])
        data = np.frombuffer(b"".join(pieces.to_pylist()), np.uint8)
        least, _ = least_owners(data, sizes, t.column("k").to_numpy(), t.column("owner").to_numpy(), length)
        n = sizes - length + 1
        row, place = np.repeat(np.arange(len(n)), n), bv.ranges(np.zeros(len(n), np.int64), n)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
        a = np.flatnonzero(new)
        ends = place[np.append(a[1:], len(row)) - 1] + length
        at = np.searchsorted(row[a], np.arange(len(n) + 1))
        fields = [pa.array(place[a]), pa.array(ends), pa.array(least[a])]
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(fields, ["a", "z", "least"]))
        return pa.RecordBatch.from_arrays([pa.array(t.column("k").to_numpy()), pieces.cast(pa.binary()), lists], names=["k", "piece", "runs"])

    combined = rows.groupBy("k", "piece").agg(F.min("doc_id").alias("owner"))
    solved = combined.repartition(tasks, "k").sortWithinPartitions("k").mapInArrow(sort, "k long, piece binary, runs array<struct<a: long, z: long, least: long>>")
    solved = staged(solved, "repeat-runs")
    hit = rows.join(solved, ["k", "piece"]).select("doc_id", "row_key", "lo", F.explode("runs").alias("r")).where("r.least < doc_id")
    return hit.select("doc_id", "row_key", (F.col("lo") + F.col("r.a")).alias("lo"), (F.col("lo") + F.col("r.z")).alias("hi"))


def _spans(row: np.ndarray, at: np.ndarray, doc: np.ndarray, key: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of consecutive places of a row as byte spans."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    a = np.flatnonzero(new)
    z = (np.append(a[1:], len(row)) - 1)[: len(a)]
    return pa.RecordBatch.from_arrays([pa.array(doc[row[a]]), pa.array(key[row[a]]), pa.array(at[a].astype(np.int64)), pa.array((at[z] + length).astype(np.int64))], names=["doc_id", "row_key", "lo", "hi"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (binary) if asked for.

    Every byte covered by a ``length``-byte string that also starts in a document with a smaller id is
    removed; strings are judged on the input. Null text is empty. A null id is larger than any other, and
    rows that share an id do not remove each other's bytes. A text shorter than ``length`` bytes stays
    whole. Texts are bytes: what is kept may cut a character. An empty table gives no rows.
    """
    spans = removed_spans(docs, id_col, text_col, length, hot).select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "spans")

    def strip(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in (every.slice(at, ROWS) for every in batches for at in range(0, every.num_rows, ROWS)):
            out = []
            n = b.column(2).value_lengths().fill_null(0).to_numpy()
            flat, row = b.column(2).flatten(), np.repeat(np.arange(b.num_rows), n)
            lo, hi = (flat.field(k).to_numpy() for k in range(2))
            order = np.lexsort((hi, lo, row))
            lo, hi, ends = lo[order], hi[order], np.cumsum(n)
            for i, (first, last) in enumerate(zip((ends - n).tolist(), ends.tolist())):
                text = unzip.decompress(b.column(1)[i].as_py())
                size, gone, runs, kept, at = len(text), 0, 0, [], 0
                for x, y in zip(lo[first:last].tolist(), hi[first:last].tolist()):
                    if x > at or runs == 0:
                        kept.append(text[at:x])
                        runs += 1
                        at = x
                    gone += max(0, y - at)
                    at = max(at, y)
                kept = b"".join([*kept, text[at:]])
                out.append((size, gone, runs, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = _zip(docs, id_col, text_col)
    joined = whole.join(spans, (whole["doc_id"] == spans["d"]) & (whole["row_key"] == spans["k"]), "left").select("doc_id", "z", "spans")
    out = joined.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != _LAST, F.col("doc_id")))
    return out if with_bytes else out.drop("kept")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, CAST(length(x) / 2 AS BIGINT))) AS i FROM d),
w AS (SELECT doc_id, i, CASE WHEN 2 * i + 100 <= length(x) THEN md5(substr(x, CAST(2 * i + 1 AS BIGINT), 100)) END AS g, substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS c FROM p),
r AS (SELECT doc_id, i, c, CASE WHEN g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id THEN i END AS hit FROM w),
m AS (SELECT doc_id, i, c, coalesce(i - max(hit) OVER (PARTITION BY doc_id ORDER BY i) < 50, false) AS gone FROM r),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM m),
a AS (
  SELECT doc_id, count_if(gone) AS n_removed, count_if(head) AS n_spans,
         sha256(unhex(coalesce(string_agg(CASE WHEN NOT gone THEN c END, '' ORDER BY i), ''))) AS kept_sha256
  FROM s GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

QUERIES = {"op6_suffix_dedup": op6}
ORACLES = {"op6_suffix_dedup": ORACLE}
