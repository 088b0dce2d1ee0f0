import pytest

from larkspur import sources


@pytest.mark.parametrize("fmt", sources.FORMATS)
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "k long, s string, v double")
    path = str(tmp_path / fmt)
    sources.write_table(df, path, fmt)
    back = sources.read_files(spark, path, fmt, df.schema)
    assert sorted(map(tuple, back.collect())) == [(1, "a", 1.5), (2, None, 2.5)]


def test_partitioned_write_prunes(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "id % 4 AS p")
    sources.write_table(df, str(tmp_path / "t"), partition_by=["p"])
    back = sources.read_files(spark, str(tmp_path / "t")).where("p = 1")
    assert back.count() == 5
    assert "PartitionFilters: [isnotnull(p" in back._jdf.queryExecution().toString()


def test_unknown_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        sources.read_table(spark, str(tmp_path), "nope")
    with pytest.raises(ValueError):
        sources.read_files(spark, str(tmp_path), "nope")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from larkspur.sources import scratch

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default), sparkContext=SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(RuntimeError):
        scratch(cluster, "x")
    cluster.conf.get = lambda name, default=None: "/shared/"
    a, b = scratch(cluster, "x"), scratch(cluster, "x")
    assert a != b and a.startswith("/shared/x-")
