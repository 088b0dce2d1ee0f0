import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur import operators as ops
from larkspur.operators import split_windows as sw

T0 = datetime(2024, 1, 1)
SCHEMA = "k int, ts timestamp, id int, v int, `a.b` string"


def events(seed, n=700, keys=(1, 1, 1, 1, 2, 3, None), gaps=(0, 1, 1, 5, 60, 61, 200)):
    """Keys of very different sizes, tied times, null keys, and gaps about an hour."""
    rng, at, rows = random.Random(seed), {}, []
    for i in range(n):
        k = rng.choice(keys)
        at[k] = at.get(k, 0) + rng.choice(gaps)
        rows.append((k, T0 + timedelta(minutes=at[k]), i, rng.choice([None, None, rng.randrange(100)]), "x"))
    rng.shuffle(rows)
    return rows


@pytest.fixture(params=[1], ids=str)
def table(request, spark):
    return spark.createDataFrame(events(request.param), SCHEMA).repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def tasks(df):
    """In how many tasks the rows of the result were made."""
    return len(df.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.hash(*(f"`{c}`" for c in df.columns)))).collect())


@pytest.mark.parametrize("rows", [10, 100_000])
def test_running_sums(table, rows):
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows_of(ops.running_sum(table, ["k"], ["ts", "id"], "v", rows=rows)) == rows_of(table.withColumn("running", F.sum("v").over(w)))


@pytest.mark.parametrize("rows", [10, 100_000])
def test_fill_forward(table, rows):
    one = table.sparkSession.createDataFrame(table.dropDuplicates(["k", "ts"]).collect(), SCHEMA)  # among equal times the last value is any
    w = Window.partitionBy("k").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    assert rows_of(ops.fill_forward(one, "k", "ts", "v", rows=rows)) == rows_of(one.withColumn("v", F.last("v", ignorenulls=True).over(w)))


@pytest.mark.parametrize("rows", [10, 100_000])
def test_asof_join(table, rows):
    left, right = table.where("id % 2 = 0"), table.where("id % 2 = 1")
    got = {r.id: r.asof_id for r in ops.asof_join(left, right, ["k"], "ts", ["ts", "id"], rows=rows).collect()}
    them = right.collect()
    for r in left.collect():
        want = max(((x.ts, x.id) for x in them if x.k == r.k and x.ts <= r.ts), default=(None, None))
        assert got[r.id] == want[1]


@pytest.mark.parametrize("rows", [2, 100_000])
@pytest.mark.parametrize("gap", [60, 7200, 10**6])
def test_sessions(table, rows, gap):
    w = Window.partitionBy("k").orderBy("ts")
    new = F.coalesce(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) >= gap * 1_000_000, F.lit(True))
    want = table.withColumn("s", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = want.groupBy("k", "s").agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("n_events")).drop("s")
    assert rows_of(ops.sessions(table, gap, "k", rows=rows)) == rows_of(want)


def test_one_key_with_all_rows_uses_every_task(spark):
    rows = [(1, T0 + timedelta(minutes=3 * i), i, i if i % 5 == 0 else None, "x") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        w = Window.partitionBy("k").orderBy("ts")
        assert tasks(df.withColumn("n", F.row_number().over(w))) == 1
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert tasks(ops.running_sum(df, ["k"], ["ts", "id"], "v", rows=50)) == n
        assert tasks(ops.fill_forward(df, "k", "ts", "v", rows=50)) == n
        assert tasks(ops.asof_join(df, df, ["k"], "ts", ["id"], rows=50)) == n
        placed = sw.ranged(df, ["k"], "ts", 50).groupBy("_range").count().collect()
        assert len(placed) == 80 and max(r["count"] for r in placed) <= 75
        assert [(r.n_events, r.session_start) for r in ops.sessions(df, 600, "k", rows=50).collect()] == [(4000, T0)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_null_times_and_empty(spark):
    rows = [(1, None if i % 3 == 0 else T0 + timedelta(minutes=i), i, i, "x") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.running for r in ops.running_sum(df, ["k"], ["ts", "id"], "v", rows=5).collect()}
    total = 0
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[2])):
        total += r[3]
        assert got[r[2]] == total
    empty = spark.createDataFrame([], SCHEMA)
    for out in (ops.running_sum(empty, ["k"], ["ts"], "v"), ops.fill_forward(empty, "k", "ts", "v"), ops.asof_join(empty, empty, ["k"], "ts", ["id"]), ops.sessions(empty, 60, "k")):
        assert out.count() == 0
