import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur import streaming as st
from larkspur.sources import logs, register_logs, write_logs
from larkspur.streaming.inactivity import Runs

T0 = datetime(2024, 1, 1)


def events(n=160, seed=1):
    rng, at, rows = random.Random(seed), {}, []
    for i in range(n):
        u = rng.choice([1, 1, 2, 3, None])
        at[u] = at.get(u, 0) + rng.choice([1, 20, 59, 60, 61, 300])
        rows.append((i, T0 + timedelta(minutes=at[u]), u, rng.choice("ab"), float(i), "{}"))
    return sorted(rows, key=lambda r: r[1])


def silent(rows, gap, delay=60):
    """(user, number, last, n, kinds) of runs that are over at the last watermark."""
    end, found = max(r[1] for r in rows) - timedelta(minutes=delay), []
    for u in {r[2] for r in rows}:
        own, runs = sorted((r[1], r[3]) for r in rows if r[2] == u), []
        for t, kind in own:
            if runs and t - runs[-1][-1][0] < timedelta(minutes=gap):
                runs[-1].append((t, kind))
            else:
                runs.append([(t, kind)])
        found += [(u, k + 1, r[-1][0], len(r), len({x[1] for x in r})) for k, r in enumerate(runs) if r[-1][0] + timedelta(minutes=gap) <= end]
    return sorted(found, key=repr)


@pytest.mark.parametrize("disorder", [0, 55])
def test_alerts_over_restarts(spark, tmp_path, disorder):
    """Five micro-batches with a restart between each; rows within the watermark's delay may come in any order."""
    rows = events()
    rng = random.Random(2)
    order = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, disorder)))
    for k in range(5):
        part = order[k * len(order) // 5 : (k + 1) * len(order) // 5]
        spark.createDataFrame(part, st.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        with st.rocksdb(spark):
            out = st.run_to_files(st.inactivity(st.read_events(spark, str(tmp_path / "events"), None), 3600), str(tmp_path / "out"))
    got = sorted(((r.user_id, r.alert, r.last_event, r.n_events, r.n_kinds) for r in out.collect()), key=repr)
    assert got == silent(rows, 60) and len(got) > 20


def test_a_slot_calls_its_state_once_for_all_its_keys():
    """A thousand keys in one batch and two of them later: a few calls of state and timers, not some for each key."""
    calls, kept = [], {}

    class State:
        def exists(self):
            return "v" in kept

        def get(self):
            calls.append("get")
            return kept["v"]

        def update(self, v):
            calls.append("update")
            kept["v"] = v

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append(("set", at))

        def deleteTimer(self, at):
            calls.append(("drop", at))

    class Now:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at

    runs = Runs(1_000_000)
    runs.init(Handle())
    frame = lambda *rows: pd.DataFrame(rows, columns=["key", "micros", "kind"])
    assert list(runs.handleInputRows((3,), iter([frame(*((k, 1000 * k, "a,b") for k in range(1000)))]), Now(0))) == []
    assert calls == ["update", ("set", 1000)] or calls == [("set", 1000), "update"]
    calls.clear()
    list(runs.handleInputRows((3,), iter([frame((0, 500_000, "c"), (2**60 + 1, 0, "x")), frame((0, 3_000_000, "c"))]), Now(0)))
    assert len(calls) == 2  # the timer stays where it was
    (out,) = runs.handleExpiredTimer((3,), Now(1500), Now(1000))
    got = sorted(map(tuple, out[["key", "alert", "last", "n_events", "n_kinds"]].values.tolist()))
    assert got[0] == (0, 1, 500_000, 2, 2) and got[-1] == (2**60 + 1, 1, 0, 1, 1) and len(got) == 502 and got[1] == (1, 1, 1000, 1, 1)
    assert calls[-2:] in (["update", ("set", 1501)], [("set", 1501), "update"])


def test_keyed_table_passes_over_what_it_has(spark, tmp_path):
    table = st.KeyedTable(spark, str(tmp_path / "t"), ["k"], ["at"], buckets=4)
    batch = lambda *rows: spark.createDataFrame(rows, "k long, at long, v string")
    rows = lambda: {r.k: (r.at, r.v) for r in table.read().collect()}
    assert table.read() is None
    table.apply(batch((1, 1, "a"), (2, 1, "b"), (1, 2, "c"), (None, 1, "n")), 0)
    table.apply(batch((2, 5, "d"), (3, 1, "e"), (1, 1, "late")), 1)
    want = {1: (2, "c"), 2: (5, "d"), 3: (1, "e"), None: (1, "n")}
    assert rows() == want
    table.apply(batch((1, 9, "again")), 0)  # committed: nothing changes
    assert rows() == want
    # a batch that broke off before its commit is written anew
    spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(str(tmp_path / "t/log/batch=1")), True)
    assert not table.committed(1) and rows()[1] == (2, "c") and 3 not in rows()
    table.apply(batch((2, 5, "d"), (3, 1, "e"), (1, 1, "late")), 1)
    assert rows() == want
    table.apply(batch(), 2)
    assert table.committed(2) and rows() == want
    table.apply(batch(*((i, 10, "z") for i in range(50)), (None, 10, "z")), 3)
    assert table.vacuum() == 2 and len(rows()) == 51


def test_last_batch_comes_again(spark, tmp_path):
    table = st.KeyedTable(spark, str(tmp_path / "t"), ["user_id"], ["ts", "event_id"], buckets=3)
    rows, seen = events(90), []
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], st.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        for _ in range(2):
            st.run_to_keyed_table(st.read_events(spark, str(tmp_path / "events"), None), table, str(tmp_path / "ck"))
            seen.append(st.forget_last_commit(spark, str(tmp_path / "ck")))
    assert len(seen) > len(set(seen))
    want = {u: max((r[1], r[0]) for r in rows if r[2] == u) for u in {r[2] for r in rows}}
    assert {r.user_id: (r.ts, r.event_id) for r in table.read().collect()} == want


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, T0 + timedelta(hours=7 * i, microseconds=i), i % 4, ["info", "error"][i % 2], i / 3, '{"k": "é x"}') for i in range(60)]
    register_logs(spark)
    write_logs(spark.createDataFrame(rows, st.EVENTS), str(tmp_path / "logs"))
    return str(tmp_path / "logs"), rows


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_lines_are_read_once_whatever_the_split(spark, folder, split):
    path, rows = folder
    got = spark.read.format("lines_log").option("split", split).load(path).collect()
    assert sorted((r.event_id, r.ts, r.user_id, r.level, r.value, r.message) for r in got) == [tuple(r) for r in rows]


def test_filters_reach_the_source(spark, folder):
    path, rows = folder
    df = spark.read.format("lines_log").load(path).where("day >= '2024-01-05' AND day < '2024-01-09' AND level = 'error' AND user_id = 1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("Filter") :].split("\n")[0] if "Filter" in plan else ""
    assert "user_id" in left and "level" not in left.replace("isnotnull(level", "") and "2024-01-05" not in left
    want = [r[0] for r in rows if "2024-01-05" <= f"{r[1]:%Y-%m-%d}" < "2024-01-09" and r[3] == "error" and r[2] == 1]
    assert sorted(r.event_id for r in df.collect()) == want
    reader = logs._BatchReader(path, 1 << 20)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    assert list(reader.pushFilters([GreaterThanOrEqual(("day",), "2024-01-05"), EqualTo(("level",), "error")])) == []
    assert {p.path.rpartition("/")[2][:10] for p in reader.partitions()} == {f"{r[1]:%Y-%m-%d}" for r in rows if f"{r[1]:%Y-%m-%d}" >= "2024-01-05"}


def test_offsets_survive_a_restart_and_a_file_that_grows(spark, folder, tmp_path):
    path, rows = folder
    run = lambda: st.run_to_files(spark.readStream.format("lines_log").load(path).select("event_id"), str(tmp_path / "out"))
    assert run().count() == 60
    assert run().count() == 60
    last = logs._files(path)[-1][0]
    with open(f"{path}/{last}", "a") as f:
        f.write(f"{last[:10]}T23:59:59 info user=1 id=1000 value=0.5 more\n")
    with open(f"{path}/2024-12-31.log", "w") as f:
        f.write("2024-12-31T00:00:00 info user=1 id=1001 value=1e-3 \n")
    assert sorted(r.event_id for r in run().collect())[-2:] == [1000, 1001] and run().count() == 62


def test_a_line_that_is_none_is_an_error(spark, tmp_path):
    register_logs(spark)
    (tmp_path / "2024-01-01.log").write_text("what is this\n")
    with pytest.raises(Exception, match="no log line"):
        spark.read.format("lines_log").load(str(tmp_path)).collect()


def test_no_files(spark, tmp_path):
    register_logs(spark)
    assert spark.read.format("lines_log").load(str(tmp_path)).agg(F.count("*")).first()[0] == 0
