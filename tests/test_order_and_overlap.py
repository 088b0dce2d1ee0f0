import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur import operators as ops
from larkspur.operators import ranking
from larkspur.operators import sketches as sk

T0 = datetime(2024, 1, 1)


def intervals(seed, n, spread=1000.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lo = rng.choice([rng.uniform(-spread, spread), float(rng.randrange(-8, 9) * 8)])
        size = rng.choice([0.0, 1.0, 8.0, 64.0, rng.expovariate(1), rng.expovariate(0.01), 1e-9, spread * 3])
        rows.append((i, rng.choice("xy"), lo, lo + size))
    return rows


@pytest.mark.parametrize("by", [None, ["g"]])
def test_each_overlap_once(spark, by):
    a, b = intervals(1, 150), intervals(2, 130)
    b += [(900, "x", None, 1.0), (901, "x", 5.0, 4.0), (902, None, 0.0, 1.0)]
    schema = "id int, g string, lo double, hi double"
    on = (F.col("lo"), F.col("hi"))
    got = Counter((r.left.id, r.right.id) for r in ops.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), on, on, by).collect())
    want = Counter((i, j) for i, g, x, y in a for j, h, u, v in b if u is not None and u <= v and x <= v and u <= y and (not by or g == h))
    assert got == want and len(want) > 500


def test_long_intervals_are_few_rows(spark):
    """A thousand short intervals and a long one over all of them: the long one is a row for each bin at its home only."""
    from larkspur.operators.intervals import _placed

    df = spark.createDataFrame([(i, float(i), i + 0.5) for i in range(1000)] + [(-1, 0.0, 1e6)], "id int, lo double, hi double")
    levels = [-1, 0, 1, 2, 3, 7]
    placed = _placed(df, F.col("lo"), F.col("hi"), levels, "left").groupBy("left.id").count()
    assert {r["id"]: r["count"] for r in placed.collect()}[-1] <= 2 and placed.agg(F.max("count")).first()[0] <= 2 * len(levels)


def test_no_intervals(spark):
    df = spark.createDataFrame([], "id int, lo double, hi double")
    on = (F.col("lo"), F.col("hi"))
    assert ops.overlap_join(df, df, on, on).count() == 0


@pytest.mark.parametrize("rows", [7, 100_000])
def test_ranks_of_all_rows(spark, rows):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice([None, 1.0, 1.0, 1.0, rng.random(), 5.0]), i, "x") for i in range(300)], "v double, id int, `a.b` string").repartition(3)
    w, tied = Window.partitionBy(F.lit(1)).orderBy("v"), Window.partitionBy(F.lit(1)).orderBy("v", "id")
    want = df.withColumn("rank", F.rank().over(w)).withColumn("row_number", F.row_number().over(tied))
    got = ops.global_rank(df, "v", ["id"], rows=rows)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert sorted(r.row_number for r in ops.page(df, "v", ["id"], 3, 40, rows=rows).collect()) == list(range(81, 121))
    assert ops.page(df, "v", ["id"], 99, 40, rows=rows).count() == 0 and ops.global_rank(df.limit(0), "v", ["id"]).count() == 0


def test_ranks_do_not_broadcast_the_rows(spark):
    """The key of all rows is a constant; a join on it must neither build on the rows nor compare them with more than the bounds."""
    df = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"))
    for some in (ops.global_rank(df, "v", ["id"], rows=100), ops.page(df, "v", ["id"], 3, 40, rows=100)):
        plan = some._jdf.queryExecution().sparkPlan().toString()
        assert "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert ops.page(df, "v", ["id"], 3, 40, rows=100).count() == 40


def test_ranges_of_a_rank_are_small(spark):
    from larkspur.operators.split_windows import ranged

    df = spark.range(20_000).select(F.lit(0).alias("_all"), F.pow("id", F.lit(3.0)).alias("v"))
    assert ranged(df, ["_all"], "v", 500).groupBy("_range").count().agg(F.max("count")).first()[0] <= 700


@pytest.mark.parametrize("share", [0.3, 0.05, 0.01])
def test_heavy_hitters(spark, share):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(6000)] + [f"u{i}" for i in range(6000)]
    rng.shuffle(words)
    rows = [(w,) for w in words] + [(None,)] * 500
    df = spark.createDataFrame(rows, "k string").repartition(5)
    want = {w: n for w, n in Counter(words).items() if n >= share * len(words)}
    assert {r.k: r.n for r in ops.heavy_hitters(df, "k", share).collect()} == want
    numbers = df.select(F.expr("try_cast(substr(k, 2) AS long)").alias("k"))
    known = Counter(int(w[1:]) for w in words)
    assert {r.k: r.n for r in ops.heavy_hitters(numbers, "k", share).collect()} == {w: n for w, n in known.items() if n >= share * len(words)}


def test_summaries_are_bounded_and_miss_no_frequent_value():
    rng = random.Random(5)
    values = ["a"] * 900 + ["b"] * 500 + [f"u{i}" for i in range(5000)]
    rng.shuffle(values)
    held, short, total = ranking.summarise((pd.Series(values[i : i + 100]) for i in range(0, len(values), 100)), 20)
    assert len(held) <= 20 and total == len(values) and {"a", "b"} <= set(held.index)
    assert all(held[k] <= values.count(k) <= held[k] + short for k in held.index)


def test_heavy_hitters_refuse_what_they_cannot_keep(spark):
    df = spark.createDataFrame([], "k string")
    assert ops.heavy_hitters(df, "k", 0.1).count() == 0
    with pytest.raises(ValueError):
        ops.heavy_hitters(df, "k", 0.1, counters=5)


@pytest.fixture(scope="module")
def visits(spark):
    rng = random.Random(6)
    rows = [(T0 + timedelta(minutes=rng.randrange(72 * 60)), rng.choice("ab"), int(rng.paretovariate(0.25)) % 30_000, rng.gauss(0, 10)) for _ in range(30_000)]
    rows += [(T0, "c", None, None), (T0, "c", None, float("nan"))]
    return spark.createDataFrame(rows, "ts timestamp, kind string, who long, v double").repartition(4)


def test_merged_sketches_are_within_their_bounds(spark, visits, tmp_path):
    sk.sketch(visits, ["kind"], "who", "v", "1 hour").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    rows = visits.toPandas()
    for by in ([], ["kind"], ["kind", F.date_trunc("day", "bucket").alias("day")]):
        for r in sk.roll_up(stored, *by).select("*", sk.n_distinct().alias("users"), sk.quantile(0.9).alias("p90"), sk.rank(F.lit(0.0)).alias("below")).collect():
            own = rows
            if "kind" in r:
                own = own[own.kind == r.kind]
            if "day" in r:
                own = own[own.ts.dt.floor("D") == r.day]
            v, n = own.v.dropna(), own.who.nunique()
            assert r.n == len(own) and abs(r.users - n) <= sk.hll_error() * n + 0.5
            if len(v):
                assert abs((v <= r.p90).mean() - 0.9) <= sk.rank_error() + 1 / len(v) and abs((v <= 0).mean() - r.below) <= sk.rank_error()
            else:
                assert r.p90 is None


def test_set_algebra_of_sketches(spark, visits):
    a, b = (set(visits.where(f"kind = '{k}'").select("who").distinct().toPandas().who) for k in "ab")
    top = sk.roll_up(sk.sketch(visits, ["kind"], "who", "v", "1 hour"), "kind")
    x, y = (top.where(f"kind = '{k}'").select(F.col("theta").alias(k)) for k in "ab")
    r = x.join(y, F.lit(True)).select(sk.n_both("a", "b").alias("both"), sk.n_only("a", "b").alias("only"), sk.n_either("a", "b").alias("either")).first()
    slack = sk.theta_error() * len(a | b)
    assert abs(r.both - len(a & b)) <= slack and abs(r.only - len(a - b)) <= slack and abs(r.either - len(a | b)) <= slack
    assert len(a | b) > 1 << sk.LG_THETA


@pytest.mark.parametrize("tile,block,short", [(4096, 2_000_000, 32), (2, 40, 0)])
def test_overlap_counts_are_those_of_the_pairs(spark, monkeypatch, tile, block, short):
    """Keys with overlapping intervals of their own, ties of ends, nulls and intervals that end before they begin; in one tile and in many tiles and blocks."""
    from larkspur.operators import intervals as iv

    monkeypatch.setattr(iv, "SHORT", short)
    rng = random.Random(8)
    rows = [(rng.randrange(40), lo, hi) for _, _, lo, hi in intervals(3, 260, 300.0) if hi - lo < 400 or rng.random() < 0.1]
    rows += [(7, 5.0, 4.0), (None, 0.0, 1.0), (3, None, 1.0), (99, 9e9, 9e9)]
    df = spark.createDataFrame(rows, "k long, lo double, hi double").repartition(3)
    good = [r for r in rows if None not in r and r[1] <= r[2]]
    met = [(a[0], b[0]) for a in good for b in good if a[0] != b[0] and a[1] <= b[2] and b[1] <= a[2]]
    n, others = Counter(k for k, _ in met), Counter(k for k, _ in set(met))
    monkeypatch.setattr(iv, "TILE", tile)
    found = []
    for a_tiles in [iv._tiles(*(np.array([r[c] for r in good], np.float64 if c else np.int64) for c in range(3)))]:
        assert len(a_tiles) == (1 if tile == 4096 else -(-len({r[0] for r in good}) // 2))
        for p, a in enumerate(a_tiles):
            found += [x for b in a_tiles[p:] for x in iv._tile_counts(a, b)]
    got_n, got_others = Counter(), Counter()
    for keys, m, o in found:
        got_n.update(dict(zip(keys.tolist(), m.tolist())))
        got_others.update(dict(zip(keys.tolist(), o.tolist())))
    assert +got_n == n and +got_others == others and len(n) > 30
    assert {r.k: (r.n, r.others) for r in ops.overlap_counts(df, "k", "lo", "hi", block=block).collect()} == {k: (n[k], others[k]) for k in n}


def test_overlap_counts_make_no_pairs(spark):
    """Two thousand keys that all meet: no operator passes more rows on than a few for each key (pairs would be four million)."""
    df = spark.range(2000).select(F.col("id").alias("k"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    got = ops.overlap_counts(df, "k", "lo", "hi", block=500)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("n = 1999 AND others = 1999").count() == 2000 and ops.overlap_counts(df.limit(0), "k", "lo", "hi").count() == 0
