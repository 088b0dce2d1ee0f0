import random
import re
import zlib
from collections import Counter

import pytest

from compare import assert_same
from larkspur.llm import spelling as sp

LOWER = {i: i + 32 for i in range(65, 91)}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words, ratio=5):
    """word -> (form, root, n, n_near, form_n), by all pairs."""
    form, found = {}, {}
    for w, n in words.items():
        own = [x for x in words if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        found[w] = len(own)
    root = {}
    for w in words:
        at = w
        while form[at] is not None:
            at = form[at]
        root[w] = at
    return {w: (form[w], root[w], n, found[w], words.get(form[w])) for w, n in words.items()}


def brute(rows, dropped=199):
    total = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % dropped == 0 else run] += 1
    return grouped({w: n for w, n in total.items() if len(w) >= 6 and n >= 5})


def plain(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def words_of(seed, count, letters="abÿ", sizes=(6, 7, 8, 9, 12)):
    rng = random.Random(seed)
    found = {}
    while len(found) < count:
        w = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        for _ in range(4):  # a chain of variants of rising frequency
            found[w] = rng.choice([5, 6, 30, 150, 151, 800, 4000])
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :] if len(w) > 6 else w])
    return found


@pytest.mark.parametrize("group", [1, 8, 20_000])
def test_vocabularies_against_all_pairs(spark, group):
    words = words_of(group, 260)
    assert plain(sp.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(4), group=group)) == grouped(words)


def test_words_that_begin_and_end_alike_are_dealt_out(spark):
    """All words of one half: groups are cut until they fit, and no pair is lost."""
    rng = random.Random(5)
    words = {"abcdefgh" + "".join(rng.choice("abcd") for _ in range(8)): 5 + i for i in range(300)}
    words |= {"".join(rng.choice("abcd") for _ in range(8)) + "stuvwxyz": 5 + i for i in range(300)}
    assert plain(sp.variants(spark.createDataFrame(list(words.items()), "word string, n long"), group=20)) == grouped(words)


def test_chain_of_forms(spark):
    words = {"aaaaaaa" + "b" * k: 5 * 6**k for k in range(9)}
    got = plain(sp.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words) and got["aaaaaaa"][1] == "aaaaaaabbbbbbbb"


def texts(seed, n=60):
    rng = random.Random(seed)
    base = ["Straße", "müßig×en", "committee", "comittee", "committees", "accommodate", "acommodate", "Ünïcode", "don't", "ABCDEFG", "x" * 300, "x" * 299, "naïveté"]
    return [(i, "".join(rng.choice(base) + rng.choice([" ", "-", "\n", "Ā", "1", "é "]) for _ in range(rng.randrange(0, 120)))) for i in range(n)]


@pytest.mark.parametrize("dropped", [3, 199])
def test_texts_against_brute_force(spark, frame, dropped):
    rows = texts(dropped)
    assert plain(sp.spelling_variants(frame(rows), dropped=dropped)) == brute(rows, dropped)


def test_nulls_empty_long_and_repeated(frame):
    long = "wörterbuch " * 40_000
    rows = [(None, "variant " * 6), (1, None), (2, ""), (3, "variant varient " * 5), (3, "variant varient " * 5), (4, long), (5, "wörtrbuch " * 9), (6, "ÃÃÃÃÃÃ " * 5)]
    got = plain(sp.spelling_variants(frame(rows)))
    assert got == brute(rows) and len(got) >= 5


def test_empty(frame):
    assert sp.spelling_variants(frame([])).collect() == [] == sp.spelling_variants(frame([(1, "short words only")])).collect()


def test_minimal_automaton():
    words = sorted(a + b + c for a in ("pre", "re") for b in ("form", "port", "act") for c in ("", "s", "ed", "ing"))
    a = sp.Automaton(words)
    assert len(a.edges) < sum(map(len, words)) / 4
    for i, w in enumerate(words):
        state, number = a.start, 0
        for c in w:
            state, skipped = a.edges[state][c]
            number += skipped
        assert a.final[state] and number == i


def test_query_matches_sql(spark):
    assert_same(sp.op11(spark, "/root/testdata/sf0.001"), sp.ORACLES["op11_spelling_variants"], "/root/testdata/sf0.001")
