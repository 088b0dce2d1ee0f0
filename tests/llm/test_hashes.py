"""Texts made so that polynomial hashes modulo a power of two cannot tell them apart."""

import numpy as np
import pytest

from larkspur.llm import bytes_view as bv
from larkspur.llm import near_dedup, repeats
from larkspur.llm import sentencepiece_sampling as sp


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "ba")) for n in (1024, 2048, 4096, 8192)]


def hashes(texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    return bv.spans_hash(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)


def test_spans_differ():
    for a, b in PAIRS:
        one, other, again = hashes([a, b, a]).tolist()
        assert one == again != other


def test_equal_spans_agree_wherever_they_lie():
    rng = np.random.default_rng(3)
    buf = np.concatenate([rng.integers(0, 256, 5_000, np.uint8)] * 2)
    s = rng.integers(0, 4_000, 200)
    e = s + rng.integers(0, 900, 200)
    assert (bv.spans_hash(buf, s, e) == bv.spans_hash(buf, s + 5_000, e + 5_000)).all()
    assert len(np.unique(bv.spans_hash(buf, s, e))) == len({buf[a:b].tobytes() for a, b in zip(s, e)})


@pytest.mark.parametrize("pair", PAIRS)
def test_repeats_are_removed(frame, pair):
    a, b = pair
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(frame([(1, a), (2, b), (3, "x" * 60)])).collect()}
    seen = {a[i : i + 50] for i in range(len(a) - 49)}
    gone = set()
    for i in range(len(b) - 49):
        if b[i : i + 50] in seen:
            gone.update(range(i, i + 50))
    assert got == {1: 0, 2: len(gone), 3: 0} and gone


def test_samples_spell_their_own_text(frame):
    rows = [(i, t) for i, t in enumerate(x for p in PAIRS for x in p)]
    got = sp.sample_encode(frame(rows)).collect()
    assert got and all(r.round_trip for r in got)


def test_words_of_equal_length_are_not_near(frame):
    rows = [(i, t) for i, t in enumerate(x for p in PAIRS for x in p)]
    assert all(r.kept for r in near_dedup.near_groups(frame(rows)).collect())
