import random

import numpy as np
import pytest

from compare import assert_same
from larkspur.llm import ngram_join as nj

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width=4):
    w = (text or "").translate(LOWER).split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, num=85, den=100):
    """(doc_id, n, component) of each row, by all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and den * len(a & b) >= num * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def plain(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def families(seed, groups=6, each=25):
    """Chains and stars of texts that differ in a few words, of many sizes, about the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(groups):
        size = rng.choice([8, 15, 40, 90, 200])
        made = [[rng.choice(words) for _ in range(size)]]
        for _ in range(each):
            w = list(rng.choice(made[-2:] if g % 2 else made[:1]))
            for _ in range(rng.randrange(0, 1 + size // 20)):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(0, 2)] = [rng.choice(words)]
            made.append(w if rng.random() < 0.9 else w + w[: size // 10])
        rows += [(len(rows) + k, " ".join(w).replace("w", rng.choice("wW"))) for k, w in enumerate(made)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i, t) for i, (_, t) in zip(ids, rows)]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(frame, small):
    rows = families(3 + small)
    options = {"fragment": 16, "dealt": 3, "block": 4} if small else {}
    assert plain(nj.ngram_components(frame(rows), **options)) == brute(rows)


def test_groups_whose_hub_is_not_near(frame):
    """Texts that share most of a page with all others but are near only to some of them."""
    rng = random.Random(8)
    page = [f"p{i}" for i in range(200)]
    rows = []
    for k in range(60):
        own = [f"{k // 2}x{i}" for i in range(30)]
        rows.append((k, " ".join(page + own + ([f"{k}"] if k % 2 else []))))
    rng.shuffle(rows)
    assert plain(nj.ngram_components(frame(rows), block=5, dealt=7)) == brute(rows)


def test_similar_sets_share_a_key():
    """Every two sets at the threshold or above have a key in common, at any sizes."""
    rng = np.random.default_rng(1)
    cuts = nj.Cuts(nj.LEAST)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(1, 400)) if rng.random() < 0.7 else int(rng.integers(1, 14))
        both = rng.integers(0, 2**64, n, np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 5)), np.uint64)]) for _ in "ab")
        if 100 * len(both) < 85 * (len(a) + len(b) - n) or len(a) == len(b) == n:
            continue
        met += 1
        keys, owner = nj.segment_keys(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]), cuts)
        assert set(keys[owner == 0]) & set(keys[owner == 1])
    assert met > 500


def test_sets_that_lie_in_few_fragments_share_a_key():
    """Hashes close together leave most fragments empty; two such sets that differ wherever they have something still meet."""
    cuts = nj.Cuts(nj.LEAST)
    a = np.arange(20, dtype=np.uint64) + np.uint64(5)
    b = np.append(a[1:], np.uint64(99))
    keys, owner = nj.segment_keys(np.concatenate([a, b]), np.array([0, 20, 40]), cuts)
    assert set(keys[owner == 0]) & set(keys[owner == 1])


def test_block_links_count_alike_by_lists_and_by_product():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 280, replace=False), rng.integers(0, 2**60, 9).astype(np.uint64)])) for _ in range(40)]
    comp = np.arange(40)
    found = [nj.block_links(sets, comp, (80, 100), common) for common in (1, 7, 1000)]
    assert found[0] == found[1] == found[2] and found[0]
    a, b = (set(sets[i].tolist()) for i in found[0][0])
    assert len(a & b) >= 0.8 * len(a | b)


def test_nulls_empty_short_long_and_repeated(frame):
    long = " ".join(f"t{i % 7919}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c d"), (None, "a b"), (None, None), (7, long), (8, long + " end"), (7, long), (9, "é É a b"), (9, "a b c d"), (9, long + " end"), (10, "ok " * 5000), (11, "ok ok ok ok")]
    assert plain(nj.ngram_components(frame(rows), fragment=500)) == brute(rows)


def test_empty(frame):
    assert nj.ngram_components(frame([])).collect() == []
    assert plain(nj.ngram_components(frame([(1, None), (2, "a")]))) == [(1, 0, 1), (2, 1, 2)]


def test_query_matches_sql(spark):
    assert_same(nj.op12(spark, "/root/testdata/sf0.001"), nj.ORACLES["op12_ngram_join"], "/root/testdata/sf0.001")
