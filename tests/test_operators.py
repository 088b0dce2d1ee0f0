import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from larkspur import operators as ops
from larkspur import plans
from larkspur.functions import cosine

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_asof_join_ties_nulls_and_extra_columns(spark):
    left = spark.createDataFrame([(1, at(5), "a"), (1, at(1), "b"), (None, at(9), "c"), (2, at(3), "d")], "k int, ts timestamp, x string")
    right = spark.createDataFrame([(1, at(2), 10), (1, at(5), 11), (1, at(5), 12), (None, at(1), 13)], "k int, ts timestamp, x int")
    got = {r.x: r.asof_x for r in ops.asof_join(left, right, ["k"], "ts", ["x"]).collect()}
    assert got == {"a": 12, "b": None, "c": 13, "d": None}


def test_band_join_has_each_pair_once(spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(20)] + [(99, None)], "a int, x double")
    b = spark.createDataFrame([(i, i / 2) for i in range(40)], "b int, y double")
    got = sorted((r.a, r.b) for r in ops.band_join(a, b, "x", "y", -1.0, 1.5).collect())
    assert got == sorted((i, j) for i in range(20) for j in range(40) if -1.0 <= j / 2 - i <= 1.5)


def test_band_join_ends_where_sql_does(spark):
    """The ends are sums rounded to doubles: -513.96 is between -511.96 - 2 and -511.96 + 2, though the difference is a little more than 2."""
    ends = [(i, s, s + d) for i, (s, d) in enumerate((x, y) for x in (-511.96, -511.7, 8191.79, 4703.96, 1.5) for y in (-2.0, 2.0))]
    a = spark.createDataFrame([(i, s) for i, s, _ in ends], "a int, x double")
    b = spark.createDataFrame([(i, round(c, 2)) for i, _, c in ends], "b int, y double")
    got = sorted((r.a, r.b) for r in ops.band_join(a, b, "x", "y", -2.0, 2.0).collect())
    want = sorted((i, j) for i, s, _ in ends for j, _, c in ends if s - 2.0 <= round(c, 2) <= s + 2.0)
    assert got == want and -513.96 - -511.96 < -2.0


def test_salted_join_is_an_equi_join(spark):
    a = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0)], "k int, v int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    assert ops.salted_join(a, b, "k", 8).count() == 100
    assert ops.salted_join(a, b, "k", 8, "left_anti").count() == 1


def test_sessions_split_at_the_exact_gap(spark):
    e = spark.createDataFrame([(1, at(0)), (1, at(59)), (1, at(119)), (2, at(5))], "u int, ts timestamp")
    got = sorted((r.u, r.n_events) for r in ops.sessions(e, 3600, "u").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_funnel_and_fill(spark):
    e = spark.createDataFrame([(1, at(1), "view"), (1, at(2), "buy"), (1, at(3), "click"), (2, at(1), "click")], "u int, ts timestamp, event_type string")
    assert {r.u: r.depth for r in ops.funnel(e, ["view", "click", "buy"], "u").collect()} == {1: 2, 2: 0}
    v = spark.createDataFrame([(1, at(1), 5), (1, at(2), None), (2, at(1), None)], "u int, ts timestamp, v int")
    assert sorted((r.u, r.v) for r in ops.fill_forward(v, "u", "ts", "v").collect() if r.v) == [(1, 5), (1, 5)]


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "u int, ts timestamp, event_type string, v int")
    assert ops.sessions(e, 60, "u").count() == 0
    assert ops.funnel(e, ["a"], "u").count() == 0
    assert ops.asof_join(e, e, ["u"], "ts", ["v"]).count() == 0


def test_cosine_of_zero_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(cosine("a", "b").alias("c")).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-9 and got[1] is None


def test_nearest_searches_all_rows_in_any_blocks(spark):
    rng = random.Random(3)
    data = [(i, i % 3, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(60 + i, 1, [1.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(90, 0, [0.0] * 4), (91, 1, None), (None, 1, [1.0] * 4)]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").repartition(5)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    sim = lambda a, b: round(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, 5) if a and b and any(a) and any(b) else None
    for within in (None, "label"):
        want = set()
        for i, g, v in data:
            if i is not None and i % 10 == 0:
                other = sorted((-9 if (s := sim(v, w)) is None else s, -j) for j, h, w in data if j is not None and j != i and (h == g or not within))[-5:]
                want |= {(i, -j, None if s == -9 else s) for s, j in other}
        for block in (4, 4096):
            got = [(r.vec_id, r.other, r.sim) for r in ops.nearest(df.where("vec_id % 10 = 0"), df, 5, within=within, block=block).collect()]
            assert len(got) == len(want) and {x[:2] for x in got} == {x[:2] for x in want}
            exact = {x[:2]: x[2] for x in want}
            assert all(s == exact[i, j] or abs(s - exact[i, j]) < 2e-5 for i, j, s in got)
    assert ops.nearest(df.where("false"), df, 5).count() == 0


def test_nearest_vectors_cross_labels(spark):
    labels = {i: label for i, label in enumerate([0, 1] * 50)}
    df = spark.createDataFrame([(i, label, [1.0, i / 1000]) for i, label in labels.items()], "vec_id long, label int, embedding array<float>")
    got = plans.catalog.nearest_vectors(lambda _: df).collect()
    assert {r.other for r in got if r.vec_id == 0} == set(range(1, 11))


def test_quantiles_against_numpy(spark):
    rng = random.Random(3)
    rows = [(k, v) for k in ("a", "b", None) for v in [rng.choice([rng.random() * 1e6, 5.0, -3.0, 5.0]) for _ in range(rng.choice([1, 2, 57, 400]))]]
    rows += [("c", None), ("d", 7.0), ("d", None), ("d", float("nan")), ("e", 1.0), ("e", 1e300)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    for bins in (1, 7, 4096):
        got = {r.k: (r.p0, r.p30, r.p50, r.p1) for r in ops.quantiles(df, "k", "v", {"p0": 0.0, "p30": 0.3, "p50": 0.5, "p1": 1.0}, bins).collect()}
        assert set(got) == {k for k, _ in rows} and got["c"] == (None,) * 4
        for k in set(got) - {"c"}:
            x = [v for q, v in rows if q == k and v is not None and v == v]
            assert np.allclose(got[k], np.quantile(x, [0, 0.3, 0.5, 1]))
    assert ops.quantiles(df.limit(0), "k", "v", {"m": 0.5}).count() == 0


def test_funnel_on_ties_and_nulls(spark):
    """Each step is strictly after the one before."""
    data = [(1, 1, "view"), (1, 5, "click"), (1, 5, "purchase"), (2, 1, "view"), (2, 1, "click"), (2, 2, "click"), (2, 3, "purchase"), (3, 1, "click"), (4, None, "view"), (5, 1, "other")]
    df = spark.createDataFrame(data, "user_id int, ts int, event_type string").selectExpr("user_id", "timestamp_seconds(ts) AS ts", "event_type")
    got = {r.user_id: r.depth for r in ops.funnel(df, ["view", "click", "purchase"], "user_id").collect()}
    assert got == {1: 2, 2: 3, 3: 0, 4: 0}


def test_python_functions_on_nulls(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "i int, t string")
    assert {r.i: r.w for r in df.select("i", ops.reversed_words("t").alias("w")).collect()} == {1: "b a", 2: None, 3: ""}
    words = df.lateralJoin(ops.Words(F.col("t").outer())).select("i", "place", "word")
    assert sorted(map(tuple, words.collect())) == [(1, 1, "a"), (1, 2, "b"), (3, 1, "")]
