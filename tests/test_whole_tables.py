"""Registered queries read whole tables, however these are cut into files, and operators hold up where values lie badly."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur import operators as ops
from larkspur import plans, streaming
from larkspur.operators.quantiles import around, binned

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def in_files(spark, tmp_path_factory):
    """The events of the smallest tables in five files, the newest written first."""
    path = tmp_path_factory.mktemp("sf")
    e = spark.read.parquet(f"{SF}/events.parquet")
    n = e.count()
    for k in reversed(range(5)):
        e.where((F.col("event_id") * 5 >= k * n) & (F.col("event_id") * 5 < (k + 1) * n)).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    assert spark.read.parquet(f"{path}/events.parquet").count() == n
    return str(path)


@pytest.mark.parametrize("name", ["stream_window_counts", "stream_interval_join", "stream_sessions"])
def test_streams_do_not_depend_on_files(spark, in_files, name):
    assert rows_of(plans.QUERIES[name](spark, in_files)) == rows_of(plans.QUERIES[name](spark, SF))


def test_several_triggers_in_order_of_time_give_the_same_windows(spark, in_files, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    rows = e.collect()
    for k in range(4):
        spark.createDataFrame(rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4], e.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    counts = lambda folder, per, out: rows_of(streaming.run_to_files(streaming.window_counts(streaming.read_events(spark, folder, per)), str(tmp_path / out)).select("bucket", "event_type", "n"))
    one, four = counts(str(tmp_path / "events"), None, "one"), counts(str(tmp_path / "events"), 1, "four")
    assert one == four and one


def test_calendar_holds_every_order(spark):
    got = plans.QUERIES["recursive_months"](spark, SF)
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_calendar_of_a_century_and_of_nothing(spark):
    o = spark.sql("SELECT TIMESTAMP_NTZ '1900-03-05' AS o_orderdate UNION ALL SELECT TIMESTAMP_NTZ '1998-02-01'")
    got = plans.catalog.recursive_months(lambda _: o)
    assert got.count() == 98 * 12 and got.agg(F.sum("n")).first()[0] == 2
    assert plans.catalog.recursive_months(lambda _: o.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["outlier", "heavy", "copies"])
def test_no_range_of_a_quantile_is_full(spark, shape):
    rng = random.Random(4)
    values = {"outlier": [rng.random() for _ in range(20_000)] + [1e15], "heavy": [rng.paretovariate(0.3) for _ in range(20_000)], "copies": [float(rng.randrange(3)) for _ in range(20_000)]}[shape]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double").repartition(4)
    placed = binned(df.select(F.col("k").alias("_k"), F.col("v").alias("_v"))).groupBy("_b").agg(F.countDistinct("_v").alias("n")).agg(F.max("n")).first()[0]
    assert placed <= 60
    got = ops.quantiles(df, "k", "v", {"a": 0.0, "m": 0.5, "z": 0.9999}).first()
    values.sort()
    at = lambda p: values[int(p * (len(values) - 1))] + (values[min(len(values) - 1, int(p * (len(values) - 1)) + 1)] - values[int(p * (len(values) - 1))]) * (p * (len(values) - 1) % 1)
    assert (got.a, got.m, got.z) == pytest.approx((values[0], at(0.5), at(0.9999)))


@pytest.mark.parametrize("shape", ["even", "heavy", "copies"])
def test_quantiles_look_at_few_values_and_shuffle_no_rows(spark, shape):
    """Around a quantile are a few values in a thousand; values that many rows share have ranges of their own; rows are not dealt by their group."""
    rng = random.Random(5)
    draw = {"even": rng.random, "heavy": lambda: rng.paretovariate(0.3), "copies": lambda: rng.choice([0.5, 0.5, rng.random()])}[shape]
    df = spark.createDataFrame([(k, draw()) for k in (1, 2, None) for _ in range(20_000)] + [(9, None)], "k int, v double").repartition(4)
    at = [0.1, 0.5, 0.99]
    sizes = around(df.select(F.col("k").alias("_k"), F.col("v").alias("_v")), at).groupBy("_k", "_b").agg(F.countDistinct("_v").alias("n"))
    inside = sizes.where("_b % 2 = 1 OR _b % 4 = 2").agg(F.max("n")).first()[0]
    assert inside <= 20 or shape == "copies"
    assert shape != "copies" or sizes.where("_b % 2 = 1").agg(F.max("n")).first()[0] == 1
    got = ops.quantiles(df, "k", "v", {f"q{i}": p for i, p in enumerate(at)})
    want = df.groupBy("k").agg(*(F.percentile("v", p).alias(f"q{i}") for i, p in enumerate(at)))
    found, right = ({r.k: tuple(r)[1:] for r in df.collect()} for df in (got, want))
    assert found.keys() == right.keys() and found[9] == right[9] == (None, None, None)
    assert all(found[k] == pytest.approx(right[k], rel=1e-12) for k in (1, 2, None))
    many = [i / 40 for i in range(41)]
    assert [round(x, 9) for x in ops.quantiles(df, "k", "v", {f"q{i}": p for i, p in enumerate(many)}).where("k = 1").first()[1:]] == [
        round(x, 9) for x in df.where("k = 1").agg(*(F.percentile("v", p) for p in many)).first()]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 3
