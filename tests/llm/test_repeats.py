import hashlib
import random

import numpy as np
import pytest

from larkspur.llm import repeats as r

ROUND = 50


def brute(rows, length=ROUND):
    key = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(key(d), first.get(w, float("inf")))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key(d):
                gone[i : i + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in df.collect()), key=repr)


def test_against_brute_force(frame):
    rng = random.Random(2)
    shared = ["".join(rng.choice("abcé ") for _ in range(rng.choice([49, 50, 51, 80, 300]))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("xyz \n") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(6))]
        rows.append((rng.randrange(1000) if i % 9 else None, "".join(parts)))
    rows += [(2000, None), (2001, ""), (2002, "ab" * 700), (2003, "b" + "ab" * 300), (2004, "short"), (2005, "ab" * 700)]
    rows += rows[:2]
    assert got(r.remove_repeats(frame(rows))) == brute(rows)
    assert got(r.remove_repeats(frame(rows), hot=3)) == brute(rows)


def test_every_anchor_split_to_single_windows(frame):
    rng = random.Random(3)
    common = "".join(rng.choice("abc ") for _ in range(120))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(20)) + common[rng.randrange(30) :] + str(i)) for i in range(25)] + [(99, "ab" * 90), (100, "b" + "ab" * 80)]
    assert got(r.remove_repeats(frame(rows), hot=0)) == brute(rows)


def test_length_has_a_bound(frame):
    with pytest.raises(ValueError):
        r.remove_repeats(frame([(1, "a")]), length=256)


def test_buckets_grow_slower_than_the_input():
    bits = [r.n_bits(n) for n in (0, 10**8, 5 * 10**8, 30 * 10**9, 100 * 10**12)]
    assert bits == sorted(bits) and bits[0] == 4 and bits[-1] <= 19


def test_windows_of_one_piece_are_left_out():
    """Only windows that two pieces share are sorted; the result is that of sorting all."""
    rng = np.random.default_rng(6)
    src = bytes(rng.integers(97, 123, 3000, dtype=np.uint8))
    pieces = sorted({src[a : a + int(rng.integers(50, 85))] for a in rng.integers(0, 2900, 300)})
    anchor, owner = np.repeat(np.arange(3), 100)[: len(pieces)], rng.integers(0, 50, len(pieces))
    sizes = np.array([len(p) for p in pieces])
    least, mixed = r.least_owners(np.frombuffer(b"".join(pieces), np.uint8), sizes, anchor, owner, 50, block=7)
    at = np.cumsum(sizes - 49)
    for k in range(3):
        own = np.flatnonzero(anchor == k)
        for i, want in zip(own, r.index([pieces[i] for i in own], owner[own], 50)):
            assert least[at[i] - (sizes[i] - 49) : at[i]].tolist() == want.tolist()
    assert 0 < mixed.sum() <= len(pieces)


def test_kept_bytes(frame):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here"
    out = {x.doc_id: bytes(x.kept) for x in r.remove_repeats(frame([(1, text), (2, "A" + text + "B")]), with_bytes=True).collect()}
    assert out == {1: text.encode(), 2: b"AB"}


def test_empty(frame):
    assert r.remove_repeats(frame([])).count() == 0


def test_index_on_small_alphabets():
    rng = np.random.default_rng(0)
    for trial in range(25):
        length = int(rng.integers(3, 12))
        src = bytes(rng.integers(97, 99 + trial % 3, 400, dtype=np.uint8))
        pieces = [src[a : a + int(rng.integers(length, 40))] for a in rng.integers(0, 350, 60)]
        owner = rng.integers(0, 50, len(pieces))
        best = {}
        for p, o in zip(pieces, owner):
            for i in range(len(p) - length + 1):
                best[p[i : i + length]] = min(o, best.get(p[i : i + length], 99))
        for p, out in zip(pieces, r.index(pieces, owner, length)):
            assert [best[p[i : i + length]] for i in range(len(p) - length + 1)] == out.tolist()


def test_index_takes_any_byte():
    pieces = [bytes([255, 0, 255, 0, 255]), bytes([0, 255, 0, 1])]
    assert [x.tolist() for x in r.index(pieces, np.array([7, 3]), 3)] == [[7, 3, 7], [3, 3]]


def test_packing_round_trip():
    rng = np.random.default_rng(4)
    columns = [rng.integers(0, 1 << 63, 500, dtype=np.uint64), rng.integers(-9, 1 << 40, 500), rng.integers(1, 36, 500).astype(np.int8)]
    out, raw = r._unpack(r._pack(*columns, raw=b"after"))
    assert [x.tolist() for x in out] == [x.tolist() for x in columns] and raw == b"after"


def test_a_bucket_gets_one_witness_of_an_anchor_that_many_texts_share():
    """However many documents of a packing have an anchor; its places go past the bucket."""
    n = 500
    common, own = np.full(n, 77, np.uint64), np.arange(1000, 1000 + n).astype(np.uint64)
    docs = np.arange(n)
    whole = r.bv.mix(docs.astype(np.uint64))
    rows = [(np.concatenate([common, own]), np.arange(2 * n), np.full(2 * n, 3), np.concatenate([docs, docs]), np.concatenate([whole, whole]))]
    out = r.pack_anchors(rows, 4).to_pylist()
    by_kind = {sign: [r._read_places(x["bucket"], x["blob"]) for x in out if (x["bucket"] < 0) == sign] for sign in (True, False)}
    ((h, w, d, start, windows),) = by_kind[True]
    assert (h == 77).all() and sorted(d.tolist()) == docs.tolist() and start.tolist() == list(range(n)) and (windows == 3).all() and set(w) == set(whole)
    ((h, w, d, start, windows),) = by_kind[False]
    assert [(int(h[i]), int(start[i])) for i in np.flatnonzero(windows == 0)] == [(77, n)]
    assert sorted(h[windows > 0].tolist()) == own.tolist()
