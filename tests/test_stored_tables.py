import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import operators as ops
from larkspur.functions import variants
from larkspur.operators import snapshots as sn
from larkspur.operators import vector_index as vi
from larkspur.sources import bucket_count, exchanges, write_bucketed


@pytest.fixture
def two(spark, tmp_path):
    """Two snapshots: keys 0 to 399 but for some, with a null key and a key of two rows; and what differs."""
    rng = random.Random(1)
    old = [(i, f"v{i}", None if i % 7 == 0 else float(i)) for i in range(400) if i != 250] + [(None, "n", 1.0), (5, "twin", 2.0)]
    new = [r for r in old if r[0] not in (100, 101)] + [(250, "new", 1.0)]
    new = [(k, "changed" if k == 102 else v, None if k == 103 else x) for k, v, x in new if not (k == 5 and v == "twin")] + [(None, "another null", 1.0)]
    rng.shuffle(new)
    schema = "k long, v string, `a.b` double"
    sn.write_snapshot(spark.createDataFrame(old, schema), str(tmp_path / "old"), "k", ranges=32)
    sn.write_snapshot(spark.createDataFrame(new, schema).repartition(3), str(tmp_path / "new"), "k", like=str(tmp_path / "old"), ranges=32)
    want = {100: "deleted", 101: "deleted", 250: "inserted", 102: "changed", 103: "changed", 5: "changed", None: "changed"}
    return str(tmp_path / "old"), str(tmp_path / "new"), want


def test_differences_and_what_is_read(spark, two):
    old, new, want = two
    got = sn.snapshot_difference(spark, old, new, "k")
    assert {r.k: r.change for r in got.collect()} == want and got.count() == len(want)
    leaves, seen = sn.differing(sn._leaves(spark, old), sn._leaves(spark, new), 32)
    assert 3 <= len(leaves) <= 7 and seen <= 1 + 2 + 32
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_range" in plan or "_range#" in plan[plan.index("PartitionFilters") :]
    read = spark.read.parquet(f"{old}/rows").where(F.col("_range").isin(leaves)).count()
    assert read < 120


def test_equal_snapshots_read_nothing(spark, two):
    old, _, _ = two
    assert sn.snapshot_difference(spark, old, old, "k").count() == 0
    assert sn.differing(sn._leaves(spark, old), sn._leaves(spark, old), 32) == ([], 1)


def test_other_ranges_are_refused(spark, two, tmp_path):
    sn.write_snapshot(spark.range(50).withColumnRenamed("id", "k"), str(tmp_path / "x"), "k", ranges=4)
    with pytest.raises(ValueError, match="different ranges"):
        sn.snapshot_difference(spark, two[0], str(tmp_path / "x"), "k")


def test_empty_snapshots(spark, tmp_path):
    empty = spark.createDataFrame([], "k long, v string")
    sn.write_snapshot(empty, str(tmp_path / "a"), "k", ranges=8)
    sn.write_snapshot(spark.createDataFrame([(1, "x")], "k long, v string"), str(tmp_path / "b"), "k", like=str(tmp_path / "a"), ranges=8)
    assert sn.snapshot_difference(spark, str(tmp_path / "a"), str(tmp_path / "a"), "k").count() == 0
    assert [tuple(r) for r in sn.snapshot_difference(spark, str(tmp_path / "b"), str(tmp_path / "a"), "k").collect()] == [(1, "deleted")]


def test_bucketed_tables_join_without_an_exchange(spark):
    a = spark.createDataFrame([(i % 50, i) for i in range(500)] + [(None, -1)], "k long, x int")
    b = spark.createDataFrame([(i, str(i)) for i in range(0, 60, 2)] + [(None, "n")], "k long, y string")
    left, right = write_bucketed(a, ["k"], 6), write_bucketed(b, ["k"], 6)
    joined = left.join(right.hint("merge"), "k")
    assert exchanges(joined) == 0 == exchanges(joined.groupBy("k").count()) and exchanges(a.join(b.hint("merge"), "k")) == 2
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, a.join(b, "k").collect()))
    assert write_bucketed(a.limit(0), ["k"], 3).count() == 0


def test_buckets_grow_with_the_table(spark, monkeypatch):
    """No bucket holds much more than its share of rows, however many rows there are; the query's plan reads as many buckets."""
    from larkspur.plans import catalog

    assert bucket_count(spark.range(100), 8) == 8 and bucket_count(spark.range(2_500_000), 2) == 3 and bucket_count(spark.range(0), 8) == 8
    df = spark.range(9000).withColumnRenamed("id", "k")
    stored = write_bucketed(df, ["k"], bucket_count(df, 8, 200))
    assert stored.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 280
    monkeypatch.setattr(catalog, "bucket_count", lambda df, least: bucket_count(df, least, 300))
    some = catalog.bucketed_join(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))
    assert "SelectedBucketsCount: 20 out of 20" in some._jdf.queryExecution().executedPlan().toString()
    assert some.agg(F.sum("lines")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_variants_of_mixed_types(spark):
    texts = ['{"a": 1, "b": "x"}', '{"a": 2.5}', '{"a": "3", "c": {"d": [1, null]}}', '{"a": ', "", None, "17", "null", '{"a": null, "b": "y", "x.y": true}']
    df = spark.createDataFrame(enumerate(texts), "id int, text string").withColumn("v", variants.parsed("text"))
    fields = variants.fields_of(df.where("id IN (0, 1, 2, 8)"), F.col("v"))
    assert fields["b"] == "string" and fields["a"] == "variant" and fields["x.y"] == "boolean" and "d" in fields["c"]
    got = {r.id: r for r in df.select("id", F.col("v").isNotNull().alias("ok"), *variants.typed(F.col("v"), {"a": "int", "b": "string", "x.y": "boolean"}), variants.kind_of(F.col("v"), "a").alias("kind")).collect()}
    assert [got[i].ok for i in range(9)] == [True, True, True, False, False, False, True, True, True]
    assert (got[0].a, got[0].b, got[0].kind) == (1, "x", "BIGINT") and got[8]["x.y"] is True and got[8].kind == "VOID" and got[6].a is None
    assert variants.fields_of(df.where("id = 5"), F.col("v")) == {} and variants.fields_of(df.limit(0), F.col("v")) == {}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 3000)] + rng.normal(scale=0.35, size=(3000, 16))
    rows = [(int(i), x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    rows += [(5000, rows[0][1]), (5001, None), (5002, [0.0] * 16), (None, rows[1][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).cache()


def test_index_holds_every_row_and_finds_most(spark, clustered, tmp_path):
    vi.build(clustered, str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i/lists"))
    assert stored.count() == 3001 and stored.select("i").distinct().count() == 3001
    asked = clustered.where("vec_id % 50 = 0")
    found = vi.search(spark, str(tmp_path / "i"), asked, 10).collect()
    true = {(r.vec_id, r.other): r.sim for r in ops.nearest(asked, clustered.where("vec_id IS NOT NULL"), 10).collect()}
    hits = [r for r in found if (r.vec_id, r.other) in true]
    assert len(hits) >= 0.9 * len(true) and all(abs(r.sim - true[r.vec_id, r.other]) < 2e-5 for r in hits)
    assert max(r.compared for r in found) < 2000
    every = vi.search(spark, str(tmp_path / "i"), asked, 10, lists=10**6).collect()
    assert {(r.vec_id, r.sim) for r in every} == {(r[0], s) for r, s in true.items()} and {r.compared for r in every} == {3000}


def test_index_of_nothing(spark, clustered, tmp_path):
    vi.build(clustered.where("vec_id = 5001"), str(tmp_path / "i"))
    assert vi.search(spark, str(tmp_path / "i"), clustered.limit(3), 10).count() == 0


def test_blocks_of_vectors_are_multiplied_in_steps(spark, monkeypatch):
    """Memory for a group of queries is that of a few of them, and deals of a few rows give the same as one deal."""
    import tracemalloc

    import pyarrow as pa

    from larkspur.operators import vectors

    rng = np.random.default_rng(1)
    table = lambda n, at: pa.table({"i": np.arange(at, at + n), "g": np.zeros(n, np.int64), "v": pa.array(list(rng.normal(size=(n, 8))))})
    asking = vectors._Block(table(4096, 0))
    rows = vectors._Block(table(1024, 4000))
    tracemalloc.start()
    ids, sims = asking.nearest(rows.ids, rows.groups, rows.vectors, rows.norms, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.shape == sims.shape == (4096, 3) and peak < 40e6
    e = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 4)))], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, ops.nearest(e.where("vec_id % 50 = 0"), e, 4).collect()))
    monkeypatch.setattr(vectors, "DEAL_ROWS", 20)
    assert sorted(map(tuple, ops.nearest(e.where("vec_id % 50 = 0"), e, 4, block=3).collect())) == want and len(want) == 24
