"""The stream store: equal to the batch gate however rows are cut, unharmed by restarts and other writers, and reading no more as history grows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattloom.config import GateConfig
from wattloom.operators.gate import quality_gate
from wattloom.sinks.snapshots import Conflict, SnapshotStore
from wattloom.sources.bounds import built_in_bounds
from wattloom.streaming import ingest

RAW = "tenant_id string, building_id string, circuit_id string, circuit_type string, ingestion_source string, ts timestamp, kwh double"
START = datetime(2026, 1, 1)


def rows_of(df):
    return sorted(
        (r["tenant_id"], r["circuit_id"], r["source_system"] or "", r["ts"], r["kwh"] is not None, r["kwh"] or 0.0, r["filled"], r["data_quality_status"]) for r in df.collect()
    )


def gate(spark, rows):
    df = spark.createDataFrame(rows, RAW).withColumn("batch_id", F.concat(F.lit("u-"), F.col("building_id")))
    batches = df.select("tenant_id", "building_id", "batch_id").distinct()
    return quality_gate(df, batches, built_in_bounds(spark), None, GateConfig()).readings


def series(rng, building, circuit, kind, source, days, minutes):
    """Readings with stuck stretches, spikes, gaps of all lengths, values out of bounds and unreadable ones."""
    out, at, value, still = [], START, rng.uniform(1, 5), 0
    while at < START + timedelta(days=days):
        if rng.random() < 0.01:
            at += timedelta(minutes=rng.choice([60, 150, 400, 3000]))
            continue
        if still == 0 and rng.random() < 0.02:
            still = rng.choice([5, 9, 14, 60])
        value = value if still else round(rng.uniform(1, 5), 3)
        still = max(0, still - 1)
        v = value * rng.choice([40, 1000]) if rng.random() < 0.01 else None if rng.random() < 0.01 else value
        out.append(("t", building, circuit, kind, source, at, v))
        at += timedelta(minutes=minutes)
    return out


def world(seed, days=8):
    rng = random.Random(seed)
    rows = series(rng, "b1", "c1", "hvac", "csv_upload", days, 60) + series(rng, "b1", "c2", "main_feed", "smart_meter_api", days, 15)
    rows += series(rng, "b2", "c3", "plug_load", "csv_upload", days, 180)  # every third hour: many filled hours
    return rng, rows + series(rng, "b2", "c4", None, "csv_upload", days // 3, 60)


def deliver(spark, store, stream, epoch, rows):
    ingest.ingest_batch(store, built_in_bounds(spark), stream=stream)(spark.createDataFrame(rows, RAW), epoch)


@pytest.mark.parametrize("seed", [1])
def test_random_cuts_and_redeliveries_equal_the_gate(spark, tmp_path, seed):
    rng, rows = world(seed)
    store = ingest.Store(str(tmp_path), shards=2)
    ordered = sorted(rows, key=lambda r: r[5])
    cuts = sorted(rng.sample(range(len(ordered)), 2))
    parts = [ordered[a:b] for a, b in zip([0, *cuts], [*cuts, len(ordered)])]
    late = {i for i in range(len(rows)) if rng.random() < 0.02}
    held = [r for i, r in enumerate(ordered) if i in late]
    parts = [[r for r in p if r not in held] for p in parts] + [held]
    wrong = [(*r[:6], 99.0) for r in rng.sample(parts[1], min(8, len(parts[1])))]
    again = [r for r in parts[1] if any(r[:6] == w[:6] for w in wrong)]
    for epoch, part in enumerate([parts[0], parts[1], wrong, *parts[2:], [*again, *parts[0][:40]]]):
        deliver(spark, store, "s", epoch, part)
        if epoch == 2:
            deliver(spark, store, "s", epoch, part)  # a batch that runs again
    assert rows_of(ingest.readings(spark, store)) == rows_of(gate(spark, rows))


def test_streams_and_checkpoints_do_not_erase_each_other(spark, tmp_path):
    store = ingest.Store(str(tmp_path / "store"), shards=2)
    row = lambda h, v=2.0: ("t", "b", "c", "hvac", "csv_upload", START + timedelta(hours=h), v)
    src = str(tmp_path / "in")
    for hours, checkpoint in (([0, 1], "first"), ([5], "second")):
        spark.createDataFrame([row(h) for h in hours], RAW).write.mode("overwrite").parquet(f"{src}-{checkpoint}")
        stream = spark.readStream.schema(RAW).parquet(f"{src}-{checkpoint}")
        ingest.start_ingest(stream, store, built_in_bounds(spark), str(tmp_path / checkpoint)).awaitTermination()
    got = {r.ts.hour: r.kwh for r in ingest.readings(spark, store).filter("kwh is not null and not filled").collect()}
    assert got == {0: 2.0, 1: 2.0, 5: 2.0}
    # a later arrival of another stream with a lower number corrects
    deliver(spark, store, "third", 0, [row(5, 3.0)])
    assert {r.ts.hour: r.kwh for r in ingest.readings(spark, store).filter("not filled and kwh is not null").collect()}[5] == 3.0


def test_bytes_per_batch_stay_flat(spark, tmp_path, monkeypatch):
    store = ingest.Store(str(tmp_path), shards=1)
    read = []
    plain = SnapshotStore.locations

    def counted(self, *args, **kwargs):
        found = plain(self, *args, **kwargs)
        read.append(sum(self._fs(f)[0].getContentSummary(self._fs(f)[1]).getLength() for f in found))
        return found

    monkeypatch.setattr(SnapshotStore, "locations", counted)
    per_batch, rng, rows = [], random.Random(3), []
    for epoch in range(13):
        part = [("t", "b", f"c{c}", "hvac", "csv_upload", START + timedelta(days=epoch, hours=h), round(rng.uniform(1, 5), 3)) for c in range(2) for h in range(24)]
        rows += part
        read.clear()
        deliver(spark, store, "s", epoch, part)
        per_batch.append(sum(read))
    assert max(per_batch[11:]) <= 1.1 * max(per_batch[8:11])
    monkeypatch.undo()
    assert rows_of(ingest.readings(spark, store)) == rows_of(gate(spark, rows))


# --- the store itself ----------------------------------------------------------------------------
ITEM = "k string, v long"


def put(store, commit_id, rows, tries=10):
    df = store.spark.createDataFrame(rows, ITEM)
    return store.update(commit_id, lambda base: [store.stage("t", df.unionByName(store.read("t", ITEM, df, ["k"], base)), df, ["k"])], tries)


def items(store, version=None):
    return sorted(map(tuple, store.read("t", ITEM, version=version).collect()))


def test_interrupted_writer_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path))
    put(store, "a#0", [("x", 1), ("y", 1)])

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "_take", dies)
        with pytest.raises(RuntimeError):
            put(store, "a#1", [("x", 2)])
    assert items(SnapshotStore(spark, str(tmp_path))) == [("x", 1), ("y", 1)]
    again = SnapshotStore(spark, str(tmp_path))
    put(again, "a#1", [("x", 2)])
    put(again, "a#1", [("x", 2)])
    assert items(store) == [("x", 1), ("x", 2), ("y", 1)] and items(store, 1) == [("x", 1), ("y", 1)]


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = SnapshotStore(spark, str(tmp_path)), SnapshotStore(spark, str(tmp_path))
    put(one, "a#0", [("x", 1)])
    base = one.version()
    stage = lambda s, k, v: s.stage("t", s.read("t", ITEM, s.spark.createDataFrame([(k, 0)], ITEM), ["k"], base).unionByName(s.spark.createDataFrame([(k, v)], ITEM)), s.spark.createDataFrame([(k, 0)], ITEM), ["k"])
    first, same, other = stage(one, "x", 2), stage(two, "x", 3), stage(two, "y", 4)
    one.commit("a#1", base, [first])
    two.commit("b#0", base, [other])  # other parts: takes the next number
    with pytest.raises(Conflict):
        two.commit("b#1", base, [same])
    put(two, "b#1", [("x", 3)])
    assert items(one) == [("x", 1), ("x", 2), ("x", 3), ("y", 4)]


def test_merged_log_and_compaction(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), merge_after=3)
    for i in range(7):
        put(store, f"a#{i}", [("x" if i % 2 else "y/=%", i), (None, i)])
    want = sorted([("x", 1), ("x", 3), ("x", 5)] + [("y/=%", i) for i in (0, 2, 4, 6)])
    named = lambda: sorted((k, v) for k, v in map(tuple, store.read("t", ITEM).collect()) if k)
    assert named() == want and store.read("t", ITEM).filter("k is null").count() == 7
    assert all(store.done(f"a#{i}") for i in range(7)) and not store.done("a#7") and not store.done("b#0")
    put(store, "a#2", [("x", 99)])
    assert named() == want
    store.compact("t", ITEM, ["k"], files=0)
    assert named() == want and len(store.locations("t")) == 3
    # a part that is emptied is gone
    store.update("drop", lambda base: [store.stage("t", store.spark.createDataFrame([], ITEM), store.spark.createDataFrame([("x", 0)], ITEM), ["k"])])
    assert all(k != "x" for k, _ in named())
