import math
import random

import numpy as np
import pytest

from compare import assert_same
from larkspur.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, extra string"


def table(spark, rows):
    """Rows of (id, vector, label), with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", -1, "y") for r in rows], SCHEMA).repartition(3)


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain Lloyd on Python's numbers: {row: (code, error)} by place in ``rows``, and the books."""
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(fine[0][1]) // parts
    cut = [[v[k * size : (k + 1) * size] for k in range(parts)] for _, v in fine]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda j: (gap(x, book[j]), j))
    for _ in range(rounds):
        for k, book in enumerate(books):
            own = [[] for _ in book]
            for c in cut:
                own[near(c[k], book)].append(c[k])
            books[k] = [[sum(col) // len(some) for col in zip(*some)] if some else book[j] for j, some in enumerate(own)]
    out = []
    for (i, _), c in zip(fine, cut):
        at = [near(x, book) for x, book in zip(c, books)]
        out.append((i, "".join(f"{a:02x}" for a in at), sum(gap(x, book[a]) for x, book, a in zip(c, books, at))))
    return sorted(out, key=repr), books


def random_rows(n, seed, spread=2.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(8)] for _ in range(12)]
    return [(i, [rng.gauss(m, 0.5) for m in rng.choice(centres)], i % 3) for i in range(n)]


@pytest.mark.parametrize("block", [7, 1000])
@pytest.mark.parametrize("entries", [1, 5, 40])
def test_against_brute_force(spark, block, entries):
    rows = random_rows(150, entries)
    want, books = brute(rows, entries=entries)
    got, own, _ = vc.compress(table(spark, rows), entries=entries, block=block)
    assert sorted(((r.vec_id, r.code, r.error) for r in got.collect()), key=repr) == want
    assert own.entries.tolist() == books


def test_bounds_leave_most_parts_alone(spark):
    rows = random_rows(3000, 7)
    _, _, scanned = vc.compress(table(spark, rows), entries=12, rounds=14)
    assert scanned[0] == 4 * len(rows) and scanned[-1] < 0.2 * scanned[0] and sum(scanned) < 0.5 * 14 * scanned[0]


def test_nulls_ties_repeats_and_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, -0.5, 1.0, -1.0]
    rows = [(1, v, 0), (1, v, 0), (None, v, None), (2, None, 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [nan, 1.0, 1.0, 1.0], 1), (5, [1.0, inf, 1.0, 1.0], 1), (6, [1e-9, -1e-9, 0.0, -0.0], None), (7, [1.0, 0.0, 1.5, -1.5], 2), (8, [4e3, -4e3, 9e6, -9e6], 2)]
    want, books = brute(rows)
    got, own, _ = vc.compress(table(spark, rows), keep="label")
    rows_got = got.collect()
    assert sorted(((r.vec_id, r.code, r.error) for r in rows_got), key=repr) == want and own.entries.tolist() == books
    assert {r.label for r in rows_got} == {"0", "2", None}


def test_empty_and_unequal(spark):
    assert vc.compress(table(spark, []))[0].collect() == []
    assert vc.compress(table(spark, [(1, None, 0)]))[0].collect() == []
    with pytest.raises(Exception, match="must have 4 components"):
        vc.compress(table(spark, [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)]))[0].collect()
    with pytest.raises(ValueError, match="do not divide"):
        vc.compress(table(spark, [(1, [1.0] * 6, 0)]))


def test_large_numbers_are_exact(spark):
    rows = [(i, [1e6 * i, -3e6 + i, 0.0, 1e5], 0) for i in range(9)]
    want, _ = brute(rows, entries=3)
    assert sorted(((r.vec_id, r.code, r.error) for r in vc.compress(table(spark, rows), entries=3)[0].collect()), key=repr) == want


def test_codes_stand_for_vectors(spark):
    rows = random_rows(60, 3)
    got, books, _ = vc.compress(table(spark, rows), entries=60, rounds=1)
    of = {r.vec_id: r.code for r in got.collect()}
    assert max(np.abs(books.vector(of[i]) - v).max() for i, v, _ in rows) < 0.002


def test_query_matches_sql(spark):
    assert_same(vc.op13(spark, "/root/testdata/sf0.001"), vc.ORACLES["op13_heap_lloyd"], "/root/testdata/sf0.001")
