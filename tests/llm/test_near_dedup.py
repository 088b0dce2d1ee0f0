import random
from collections import Counter

import numpy as np
import pyarrow as pa

from larkspur.llm import bytes_view as bv
from larkspur.llm import near_dedup as n


def bag(text, width=5):
    w = (text or "").split()
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def similarity(a, b):
    a, b = bag(a), bag(b)
    u = sum((a | b).values())
    return sum((a & b).values()) / u if u else 0.0


def classes(rows):
    top = {d: d for d, _ in rows}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    bags = [(d, bag(t)) for d, t in rows]
    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            u = sum((x | y).values())
            if u and sum((x & y).values()) / u >= 0.8 - 1e-12:
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in rows}


def variants(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(5):
        made = [[rng.choice(words) for _ in range(rng.choice([4, 12, 60, 150]))]]
        for _ in range(30):
            w = list(rng.choice(made[-3:] if g % 2 else made[:1]))
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(words)
            made.append(w + w[:20] if rng.random() < 0.2 else w)
        rng.shuffle(made)
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate(made)]
    return rows


def test_classes_match_brute_force(frame):
    rows = variants(5)
    assert {r.doc_id: r.class_id for r in n.near_groups(frame(rows)).collect()} == classes(rows)


def test_blocks_of_a_hub_do_not_matter(frame):
    rows = variants(9)
    assert {r.doc_id: r.class_id for r in n.near_groups(frame(rows), block=3).collect()} == classes(rows)


def parts_of_a_page(count, seed=2):
    """A page of 40 paragraphs and pages that hold 28 of them each: near to few others, though all share much with the page."""
    rng = random.Random(seed)
    page = [" ".join(rng.choice("abcdefghijkl") + str(rng.randrange(400)) for _ in range(30)) for _ in range(40)]
    rows = [(0, "\n".join(page))]
    for k in range(count):
        rows.append((k + 1, "\n".join(page[i] for i in sorted(rng.sample(range(40), 28)))))
        if k % 10 == 0:
            rows.append((10_000 + k, rows[-1][1] + "\nand a few words more"))
    return rows


def test_parts_of_one_page(frame):
    rows = parts_of_a_page(80)
    assert {r.doc_id: r.class_id for r in n.near_groups(frame(rows), block=30).collect()} == classes(rows)


def test_few_pairs_of_a_hub_are_compared():
    rows = parts_of_a_page(200)
    hub, texts = pa.array([rows[0][1]] * (len(rows) - 1)), pa.array([t for _, t in rows[1:]])
    sim, common, weight, beyond, sketch = n.compare_with_hub(hub, texts, 0.8, 5, np.zeros(0, np.uint64))
    assert np.allclose(sim, [similarity(rows[0][1], t) for _, t in rows[1:]])
    group = n.Group([(d, d, common[i], weight[i], common[i] >= 0.8 * weight[i], 0, beyond[i].tolist(), sketch[i].astype("<i4").tobytes(), t.encode()) for i, (d, t) in enumerate(rows[1:])])
    near = {(a, b) for i, (a, s) in enumerate(rows[1:]) for b, t in rows[i + 2 :] if similarity(s, t) >= 0.8}
    left = {(group.ids[i], group.ids[j]) for i, j in group.candidates(0.8)}
    assert near <= left and len(left) < 2 * len(rows) + len(near)
    assert set(group.links(0.8, 5)) <= near


def test_nulls_empty_short_and_repeated(frame):
    rows = [(1, None), (2, ""), (3, "a b"), (4, " a\tb "), (5, "a b c"), (None, "a b"), (7, "x " * 30000), (7, "x " * 30000)]
    df = n.near_groups(frame(rows))
    got = {r.doc_id: r.class_id for r in df.collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, None: None, 7: 7}
    kept = n.keep_one(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 7]


def test_empty(frame):
    assert n.near_groups(frame([])).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    base = [f"w{rng.randrange(40)}" for _ in range(200)]
    texts = []
    for k in range(24):
        w = list(base)
        for _ in range(k % 12):
            w[rng.randrange(200)] = "q"
        texts.append(" ".join(w + w[:50] * (k % 3)))
    ((_, _, buf, offsets),) = bv.chunks(pa.array(texts))
    sig = n.signatures(*n.multisets(buf, offsets), len(texts), 2000)
    for i in range(len(texts) - 1):
        assert abs((sig[i] == sig[i + 1]).mean() - similarity(texts[i], texts[i + 1])) < 0.06
    exact = n.overlaps(pa.array(texts[:-1]), pa.array(texts[1:]))
    assert np.allclose(exact, [similarity(a, b) for a, b in zip(texts, texts[1:])])
