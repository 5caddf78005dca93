"""Starts that happen once, and retraining triggers with timers."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from wattloom.sinks.snapshots import SnapshotStore
from wattloom.streaming import starts

EVENT = "tenant_id string, building_id string, correlation_id string, timestamp string, feedback_count long"


def test_repeats_start_nothing_after_any_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(starts, "MERGE_AFTER", 3)
    store = SnapshotStore(spark, str(tmp_path), merge_after=4)
    day = datetime(2026, 1, 1)
    want = set()
    for epoch in range(6):
        rows = [("t", "b", f"c{i}", str(day + timedelta(days=100 * epoch)), None) for i in range(epoch * 5, epoch * 5 + 20)]
        run = starts.starts_batch("analysis", SnapshotStore(spark, str(tmp_path), merge_after=4), 2, stream=f"s{epoch // 3}")
        run(spark.createDataFrame(rows + rows[:3], EVENT), epoch % 3)  # a restart with another checkpoint begins at 0 again
        run(spark.createDataFrame(rows, EVENT), epoch % 3)
        want |= {r[2] for r in rows}
    got = [r["correlation_id"] for r in starts.starts(store, "analysis").collect()]
    assert sorted(got) == sorted(want)
    # deliveries are merged: the ledger does not keep a part per bucket and commit
    assert len(store.locations("ledger")) <= 2 * 4


def test_a_lost_commit_is_taken_again(spark, tmp_path, monkeypatch):
    import pytest

    store = SnapshotStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("t", "b", "c", "2026-01-01", None)], EVENT)
    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "_take", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            starts.take_starts(rows, "analysis", store, "s#0")
    assert starts.starts(store).count() == 0
    starts.take_starts(rows, "analysis", store, "s#0")
    starts.take_starts(rows, "analysis", store, "s#0")
    assert starts.starts(store).count() == 1


def test_retraining_triggers_of_one_stream(spark, tmp_path):
    day = lambda d: datetime(2026, 1, 1) + timedelta(days=d)
    batches = [
        [("b1", "trained", 0, "m1"), ("b2", "trained", 0, "m1"), ("b1", "drift", 3, "d1"), ("b1", "drift", 3, "d1"), *[("b1", "label", 4, f"l{i}") for i in range(6)]],
        [("b2", "trained", 20, "m2"), ("b1", "drift", 21, "d1"), ("b1", "label", 22, "l9")],
        [("b3", "label", 35, "x")],  # time passes: b1 is due at 30, b2 only at 50
        [("b1", "trained", 36, "m3"), ("b1", "drift", 37, "d1"), ("b3", "label", 55, "y")],
        [("b3", "label", 100, "z")],
        [("b3", "label", 101, "z2")],
    ]
    src = str(tmp_path / "in")
    schema = "tenant_id string, building_id string, kind string, ts timestamp, name string"
    for i, rows in enumerate(batches):
        spark.createDataFrame([("t", b, k, day(d), n) for b, k, d, n in rows], schema).coalesce(1).write.mode("append").parquet(src)
        stream = starts.retraining_stream(spark.readStream.schema(schema).parquet(src))
        # every run goes on from the checkpoint, as after a restart
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["building_id"], r["trigger"], (r["at"] - day(0)).days) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert ("b1", "drift", 3) in got and ("b1", "feedback_volume", 4) in got and ("b1", "calendar", 30) in got and ("b2", "calendar", 50) in got
    assert ("b1", "drift", 37) in got and ("b1", "calendar", 66) in got
    assert not [g for g in got if g[:2] == ("b1", "calendar") and 30 < g[2] < 66]  # the training at 36 moved the date
    assert len([g for g in got if g[1] == "drift"]) == 2 and len([g for g in got if g[:2] == ("b1", "feedback_volume")]) == 1


class _Held:
    """State of one key, counting the calls to it."""

    def __init__(self, calls):
        self.calls, self.value = calls, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("update", "updateValue"):
                self.value[args[0] if name == "updateValue" else ()] = args[-1]
            elif name == "clear":
                self.value.clear()
            return {"exists": bool(self.value), "get": self.value.get(()), "containsKey": bool(args) and args[0] in self.value}.get(name)

        return call


def test_calls_to_the_state_do_not_grow_with_the_rows():
    calls = []
    handle = _Held(calls)
    handle.getValueState = lambda *a: _Held(calls)
    handle.getMapState = lambda *a: _Held(calls)
    p = starts.Retraining(days=30, at=5)
    p.init(handle)
    day = datetime(2026, 1, 1)
    rows = [("drift", day + timedelta(minutes=i), f"d{i % 300}") for i in range(600)] + [("label", day + timedelta(minutes=i), f"l{i}") for i in range(600)]
    frame = lambda rows: pd.DataFrame(rows, columns=["kind", "ts", "name"])
    out = list(p.handleInputRows(("t", "b"), iter([frame(rows + [("trained", day + timedelta(days=2), "m")])]), None))
    assert len(calls) < 20 and len(out) == 1
    assert len(out[0]) == 301 and list(out[0][out[0]["trigger"] == "feedback_volume"]["dedupe_key"]) == ["retraining-feedback_volume-t-b-l4"]
    later = list(p.handleInputRows(("t", "b"), iter([frame([("drift", day + timedelta(days=3), "d1"), ("drift", day + timedelta(days=3), "d1"), ("trained", day, "old")])]), None))
    assert [list(f["dedupe_key"]) for f in later] == [["retraining-drift-t-b-d1"]]
    # a stamp that came since the last training starts nothing again
    assert not list(p.handleInputRows(("t", "b"), iter([frame([("drift", day + timedelta(days=4), "d1")])]), None))
