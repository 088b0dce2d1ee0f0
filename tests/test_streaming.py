from datetime import datetime, timedelta

import pytest

from larkspur import streaming

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stream") / "events"
    for part in range(3):  # later files hold later events, but for one late row in the last
        rows = [(part * 100 + i, T0 + timedelta(minutes=240 * part + 10 * i), i % 3, "view" if i % 2 else "buy", 1.0, "{}") for i in range(20)]
        if part == 2:
            rows.append((999, T0, 0, "view", 1.0, "{}"))
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def run(df, name, mode, tmp_path):
    return streaming.run_to_memory(df, name, mode, str(tmp_path / "ck")).collect()


def test_complete_counts_hold_every_row(spark, folder, tmp_path):
    got = run(streaming.window_counts(streaming.read_events(spark, folder)), "w1", "complete", tmp_path)
    assert sum(r.n for r in got) == 61


def test_append_gives_closed_windows_once(spark, folder, tmp_path):
    got = run(streaming.window_counts(streaming.read_events(spark, folder, delay="10 minutes")), "w2", "append", tmp_path)
    keys = [(r.bucket, r.event_type) for r in got]
    assert keys and len(keys) == len(set(keys))


def test_sessions_close(spark, folder, tmp_path):
    got = run(streaming.session_counts(streaming.read_events(spark, folder, delay="100 hours"), "1 hour"), "s1", "complete", tmp_path)
    assert sum(r.n for r in got) == 61


def test_interval_join_pairs(spark, folder, tmp_path):
    e = streaming.read_events(spark, folder, delay="10 hours")
    got = run(streaming.interval_join(e.where("event_type = 'view'"), e.where("event_type = 'buy'"), "30 minutes"), "j1", "append", tmp_path)
    batch = spark.read.parquet(folder)
    a, b = batch.where("event_type = 'view'").alias("a"), batch.where("event_type = 'buy'").alias("b")
    from pyspark.sql import functions as F

    want = a.join(b, F.expr("a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 minutes")).count()
    assert len(got) == want > 0


def test_running_totals_end_at_all_rows(spark, folder, tmp_path):
    got = run(streaming.running_totals(streaming.read_events(spark, folder)), "t1", "update", tmp_path)
    last = {}
    for r in got:
        last[r.user_id] = max(last.get(r.user_id, 0), r.n)
    assert sum(last.values()) == 61


def test_first_of_key(spark, folder, tmp_path):
    got = run(streaming.first_of_key(streaming.read_events(spark, folder, delay="100 hours")), "f1", "append", tmp_path)
    assert len(got) == 61
