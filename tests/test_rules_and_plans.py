"""Rules, calendars, merges and stored tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattloom.operators import calendar, rules, scenarios
from wattloom.sinks.merge import upsert_files
from wattloom.sources.calendars import read_closures
from wattloom.sources.rules import Rule, floor_mod, require_versions, rule_table

SAT = dt.datetime(2026, 6, 27, 12)


def sample(spark):
    rows = [("t", "b", c, k, SAT, v, q) for c, k, v, q in (("1", "hvac", 150.0, "pass"), ("2", "plug_load", 130.0, "pass"), ("3", "main_feed", 160.0, "degraded"), ("4", "hvac", 900.0, "quarantined"), ("5", "hvac", None, "pass"))]
    r = spark.createDataFrame(rows, "tenant_id string, building_id string, circuit_id string, circuit_type string, ts timestamp, kwh double, data_quality_status string")
    b = spark.createDataFrame([("t", "b", 100.0, ([1, 2, 3, 4, 5], "08:00", "18:00"))],
                              "tenant_id string, building_id string, declared_unoccupied_baseline double, occupancy_schedule struct<days:array<int>,start:string,end:string>")
    return r, b


def test_known_readings_fire_known_rules(spark):
    got = {r.rule_id for r in rules.fired(*sample(spark)).collect()}
    assert got == {"hvac_after_hours_v3", "weekend_vampire_load_v1", "scheduling_violation_v1"}


def test_rule_conditions_may_use_context_only(spark):
    r, b = sample(spark)
    with pytest.raises(Exception):
        rules.fired(r, b, [Rule("x", 1, "tenant_id = 't'", "c")]).collect()


def test_null_and_failing_conditions_do_not_fire(spark):
    r, b = sample(spark)
    assert rules.fired(r, b, [Rule("x", 1, "kwh / nullif(kwh - kwh, 0) > 1", "c")]).count() == 0


def test_floor_mod(spark):
    got = spark.range(1).select(floor_mod(F.lit(-7), F.lit(3)).alias("m")).first().m
    assert got == 2


def test_older_rule_version_fails(spark):
    reg = spark.createDataFrame([("hvac_after_hours_v3", 4)], "rule_id string, version int")
    with pytest.raises(Exception, match="older than registered"):
        require_versions(rule_table(spark), reg).collect()


def test_closures_over_holidays_over_weekends(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("date,description\n2026-01-04, stocktaking \n2026-01-01,\n")
    b = spark.createDataFrame([("t", "b")], "tenant_id string, building_id string")
    closures = read_closures(spark, str(p)).crossJoin(b)
    hol = spark.createDataFrame([(dt.date(2026, 1, 1), "h"), (dt.date(2026, 1, 2), "h")], "date date, source string")
    got = {r.date.day: (r.day_type, r.source) for r in calendar.build_calendar(b, hol, closures, "2026-01-01", "2026-01-05").collect()}
    assert got == {1: ("declared_closure", "customer_upload"), 2: ("holiday", "h"), 3: ("weekend", "auto:weekday_check"), 4: ("declared_closure", "customer_upload:stocktaking"), 5: ("business_day", "auto:remainder")}


def test_upsert_files_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "r")
    cols = "tenant_id string, circuit_id string, ts timestamp, kwh double, data_quality_status string, source string, date date, batch_seq int"
    d1, d2 = dt.datetime(2026, 1, 1, 5), dt.datetime(2026, 1, 2, 5)
    upsert_files(path, spark.createDataFrame([("t", "c", d1, 1.0, "pass", "a", d1.date(), 1), ("t", "c", d2, 2.0, "pass", "a", d2.date(), 1)], cols))
    before = {f.name for f in (tmp_path / "r" / "tenant_id=t" / "date=2026-01-01").iterdir()}
    batch = spark.createDataFrame([("t", "c", d2, 9.0, "degraded", "b", d2.date(), 2), ("t", "n", d2, 3.0, "pass", "b", d2.date(), 2)], cols)
    for _ in range(2):  # a repeated batch changes nothing
        upsert_files(path, batch)
    got = {(r.circuit_id, r.ts.day): (r.kwh, r.data_quality_status, r.source) for r in spark.read.parquet(path).collect()}
    assert got == {("c", 1): (1.0, "pass", "a"), ("c", 2): (9.0, "degraded", "a"), ("n", 2): (3.0, "pass", "b")}
    assert {f.name for f in (tmp_path / "r" / "tenant_id=t" / "date=2026-01-01").iterdir()} == before


def test_scenario_registry_refuses_repeats():
    r = scenarios.default_registry()
    with pytest.raises(ValueError):
        r.add("load_shift_v1", scenarios.load_shift)


def test_erasing_a_foreign_building_fails(spark):
    from wattloom.operators.retention import require_owned

    b = spark.createDataFrame([("t", "b", "n")], "tenant_id string, building_id string, name string")
    with pytest.raises(Exception, match="not found for tenant"):
        require_owned(spark.createDataFrame([("u", "b")], "tenant_id string, building_id string"), b).collect()


def test_stream_pieces_of_an_hour_add_up(spark, tmp_path):
    """Quarter hours pushed one by one, one of them late, give whole hours."""
    import json

    from wattloom.sources.bounds import built_in_bounds
    from wattloom.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    store = ingest.Store(str(tmp_path / "store"))
    pieces = [(h, q) for h in range(6) for q in range(4)]
    pieces.append(pieces.pop(5))
    stamps = [f"2026-01-05T{h:02d}:{15 * q:02d}:00Z" for h, q in pieces]
    for part in (stamps[:10], stamps[10:20], stamps[20:]):
        rows = [{"meter_id": "m", "timestamp": s, "kwh": 1.0, "circuit_type": "hvac"} for s in part]
        doc = {"tenant_id": "t", "building_id": "b", "value": json.dumps({"readings": rows})}
        (src / f"{part[0][11:16].replace(':', '')}-{len(list(src.iterdir()))}.json").write_text(json.dumps(doc) + "\n")
        stream = spark.readStream.schema("tenant_id string, building_id string, value string").json(str(src))
        ingest.start_ingest(ingest.payload_stream(stream), store, built_in_bounds(spark), str(tmp_path / "cp")).awaitTermination()
    got = {r.ts.hour: r.kwh for r in ingest.readings(spark, store).collect()}
    assert got == {h: 4.0 for h in range(6)}


def _push(spark, store, seq, rows):
    """One micro-batch of (stamp, kwh) readings of a single meter."""
    from datetime import datetime

    from wattloom.sources.bounds import built_in_bounds
    from wattloom.streaming import ingest

    df = spark.createDataFrame(
        [("t", "b", "c", "hvac", "csv_upload", datetime.fromisoformat(s), v) for s, v in rows],
        "tenant_id string, building_id string, circuit_id string, circuit_type string, ingestion_source string, ts timestamp, kwh double",
    )
    ingest.ingest_batch(store, built_in_bounds(spark), stream="pushed")(df, seq)
    return {r.ts: (r.kwh, r.data_quality_status) for r in ingest.readings(spark, store).collect()}


def test_stream_redelivery_and_correction(spark, tmp_path):
    from wattloom.streaming import ingest

    store = ingest.Store(str(tmp_path / "store"), shards=2)
    rows = [(f"2026-01-05 {h:02d}:00:00", 2.0) for h in range(5)]
    once = _push(spark, store, 0, rows)
    assert sum(v for v, _ in once.values()) == 10.0
    assert _push(spark, store, 1, rows) == once
    assert _push(spark, store, 1, rows) == once
    fixed = _push(spark, store, 2, [("2026-01-05 02:00:00", 5.0)])
    assert sum(v for v, _ in fixed.values()) == 13.0 and len(fixed) == 5


def test_stream_keeps_empty_days(spark, tmp_path):
    from wattloom.streaming import ingest

    store = ingest.Store(str(tmp_path / "store"))
    _push(spark, store, 0, [(f"2026-01-05 {h:02d}:00:00", 2.0) for h in range(5)])
    got = _push(spark, store, 1, [(f"2026-01-20 {h:02d}:00:00", 2.0) for h in range(6)])
    assert len(got) == 15 * 24 + 6
    assert sum(1 for v, s in got.values() if v is None and s == "quarantined") == 15 * 24 + 6 - 11


def test_failing_conditions_are_not_met(spark):
    from datetime import datetime

    from wattloom.operators.rules import fired
    from wattloom.sources.rules import Rule

    conditions = {
        "division": "1.0 / kwh > 0.1", "modulo": "5 % cast(kwh as int) = 1", "cast": "cast('x' || kwh as double) > 0",
        "overflow": "cast('99999999999' as int) > kwh", "element": "array(1, 2)[5] > 0", "stamp": "to_timestamp('no') > ts", "fine": "kwh >= 0",
    }
    rules = [Rule(k, 1, c, "test") for k, c in conditions.items()]
    readings = spark.createDataFrame(
        [("t", "b", "c", "hvac", datetime(2026, 1, 5, h), float(h * 2), "pass") for h in range(3)],
        "tenant_id string, building_id string, circuit_id string, circuit_type string, ts timestamp, kwh double, data_quality_status string",
    )
    buildings = spark.createDataFrame([], "tenant_id string, building_id string, declared_unoccupied_baseline double, occupancy_schedule struct<days:array<int>,start:string,end:string>")
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    got = sorted((r.rule_id, r.kwh) for r in fired(readings, buildings, rules).collect())
    assert got == [("division", 2.0), ("division", 4.0), ("fine", 0.0), ("fine", 2.0), ("fine", 4.0), ("modulo", 2.0), ("modulo", 4.0)]
    assert spark.conf.get("spark.sql.ansi.enabled") == ansi


def test_circuits_of_two_tenants_with_one_label(spark):
    from datetime import datetime

    from wattloom.sinks.records import get_or_create_circuits

    raw = spark.createDataFrame([("t1", "b", "m", "hvac", datetime(2026, 1, 1), 1), ("t2", "b", "m", "hvac", datetime(2026, 1, 1), 1)], "tenant_id string, building_id string, meter_id string, circuit_type string, ts timestamp, seq int")
    known = spark.createDataFrame([("c1", "t1", "b", "m", "hvac")], "circuit_id string, tenant_id string, building_id string, label string, circuit_type string")
    assert sorted(r.tenant_id for r in get_or_create_circuits(raw, known).collect()) == ["t1", "t2"]
