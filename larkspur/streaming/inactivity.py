"""Alerts for keys that have fallen silent: state with timers on event time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keys are dealt into so many slots, each of them one state; a checkpoint keeps the number that it began with.
SLOTS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Runs(StatefulProcessor):
    """Of the keys of one slot: their runs of events, each less than a gap from the next, and how many alerts a key has had; and one timer, at the end of the earliest run.

    A call of the state or of a timer takes far longer than a row, so a slot's runs are one value, read and written once a batch, whatever number of keys
    it holds. Events can come in any order while the watermark lets them: a new one begins a run, makes one longer or joins two.
    """

    def __init__(self, gap_micros: int) -> None:
        self.gap = gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("slot", "held string")

    def _due(self, last: int) -> int:
        """The millisecond by which a run that has ``last`` as its last event is over."""
        return -(-(last + self.gap) // 1000)

    def _load(self) -> tuple[dict, int | None]:
        """key: (alerts, runs of start, last, n, kinds), and the millisecond of the timer."""
        if not self.state.exists():
            return {}, None
        held, timer = json.loads(self.state.get()[0])
        return {k: (n, runs) for k, n, runs in held}, timer

    def _store(self, held: dict, timer: int | None) -> None:
        """Write the state and set its timer, where ``timer`` is the one that is set now."""
        first = min((self._due(r[1]) for _, runs in held.values() for r in runs), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.state.update((json.dumps([[(k, n, runs) for k, (n, runs) in held.items()], first]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._load()
        for f in rows:
            new: dict[int, list] = {}
            for k, t, kind in zip(f["key"].tolist(), f["micros"].tolist(), f["kind"].tolist()):
                new.setdefault(k, []).append([t, t, 1, [kind]])
            for k, more in new.items():
                n, runs = held.get(k, (0, []))
                joined: list[list] = []
                for start, last, count, kinds in sorted([*runs, *more]):
                    if joined and start - joined[-1][1] < self.gap:
                        run = joined[-1]
                        run[1], run[2] = max(run[1], last), run[2] + count
                        run[3] += [x for x in kinds if x not in run[3]]
                    else:
                        joined.append([start, last, count, kinds])
                held[k] = n, joined
        self._store(held, timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held, _ = self._load()
        out = []
        for k, (n, runs) in held.items():
            over = [r for r in runs if self._due(r[1]) <= now]  # in order of their beginnings, and so of their ends
            out += [(k, n + i, last, count, len(kinds)) for i, (_, last, count, kinds) in enumerate(over, 1)]
            held[k] = n + len(over), runs[len(over) :]
        self._store(held, None)  # the timer that expired is gone
        if out:
            yield pd.DataFrame(out, columns=["key", "alert", "last", "n_events", "n_kinds"]).assign(unkeyed=key[0] < 0)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def inactivity(events: DataFrame, gap_seconds: int, key: str = "user_id", ts: str = "ts", kind: str = "event_type", slots: int = SLOTS) -> DataFrame:
    """key, alert (number of the key's alert), last_event, n_events, n_kinds: an alert once the watermark is ``gap_seconds`` past a key's last event.

    ``events`` is a stream with a watermark on ``ts``. n_events and n_kinds are of the events since the alert before; of
    a key that comes back there is a next alert. Null keys are one key; null times have no event time and are left out; a null kind counts as one.
    Keys share ``slots`` states; a slot's keys and open runs are held together while its batch is handled, so very many keys want more slots.
    """
    own = F.col(key).cast("long")
    # a null key has a slot of its own, so that no number is read as a fraction
    slot = F.when(own.isNull(), -1).otherwise(F.pmod(F.xxhash64(own), F.lit(slots)).cast("int"))
    rows = events.where(F.col(ts).isNotNull()).select(slot.alias("slot"), F.coalesce(own, F.lit(0)).alias("key"), ts, F.unix_micros(ts).alias("micros"), F.coalesce(F.col(kind), F.lit("")).alias("kind"))
    found = rows.groupBy("slot").transformWithStateInPandas(Runs(gap_seconds * 1_000_000), "key long, alert long, last long, n_events long, n_kinds long, unkeyed boolean", "Append", "EventTime")
    named = F.when(~F.col("unkeyed"), F.col("key"))
    return found.select(named.alias(key), "alert", F.timestamp_micros("last").alias("last_event"), "n_events", "n_kinds")
