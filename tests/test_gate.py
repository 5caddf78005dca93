"""Quality gate on small days of known shape."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattloom.config import GateConfig
from wattloom.operators import faults, gate, resample
from wattloom.plans.ingest import ingest_dataset
from wattloom.sources.bounds import active_bounds, bounds_from_json, built_in_bounds

HVAC = "HVAC-001"


def lines(hours, kwh=lambda h: 20.0 + h % 5, meter=HVAC, kind="hvac", zone="+05:30"):
    return [f"{meter},2026-01-15T{h:02d}:00:00{zone},{kwh(h)},{kind}" for h in hours]


def write(tmp_path, rows, header="meter_id,timestamp,kwh,circuit_type", bom=False):
    p = tmp_path / "meters.csv"
    p.write_text(("﻿" if bom else "") + "\n".join([header, *rows]) + "\n", encoding="utf-8")
    return str(p)


def run(spark, path, **kw):
    return ingest_dataset(spark, path, "default", "t", "b", "Asia/Kolkata", **kw)


def types(result):
    return {r.issue_type for r in result.issues.select("issue_type").distinct().collect()}


def test_clean_day_passes(spark, tmp_path):
    rows = lines(range(24)) + lines(range(24), lambda h: 5.0 + h % 3, "LIGHT-001", "lighting")
    r = run(spark, write(tmp_path, rows, bom=True))
    b = r.batches.first()
    assert b.overall_status == "pass" and b.total_rows == b.pass_count >= 46


def test_short_gap_is_filled_without_issue(spark, tmp_path):
    hours = [h for h in range(24) if h not in (10, 11)]
    r = run(spark, write(tmp_path, lines(hours)))
    assert "gap_beyond_bound" not in types(r)
    assert r.readings.filter("kwh IS NOT NULL").count() >= 22
    assert r.readings.filter("filled").count() == 2


def test_long_gap_is_quarantined(spark, tmp_path):
    hours = [h for h in range(24) if not 8 <= h <= 14]
    r = run(spark, write(tmp_path, lines(hours)))
    assert "gap_beyond_bound" in types(r)
    assert r.readings.filter("data_quality_status = 'quarantined'").count() == 7


def test_stuck_value(spark, tmp_path):
    r = run(spark, write(tmp_path, lines(range(24), lambda h: 25.0 if 3 <= h <= 14 else 20.0 + h)))
    assert "stuck_at_value" in types(r)


def test_dropout(spark, tmp_path):
    r = run(spark, write(tmp_path, lines([h for h in range(24) if not 5 <= h <= 8])))
    assert "dropout" in types(r)


def test_implausible_values(spark, tmp_path):
    r = run(spark, write(tmp_path, lines(range(24), lambda h: {3: -5.0, 9: 9999.0}.get(h, 20.0 + h % 5))))
    assert r.readings.filter("data_quality_status = 'quarantined'").count() == 2


def test_drifted_schema_degrades(spark, tmp_path):
    r = run(spark, write(tmp_path, lines(range(24)), "meter_id,timestamp,kwh,extra_field"))
    assert "schema_drift" in types(r) and r.batches.first().overall_status == "degraded"


def test_missing_required_column_quarantines(spark, tmp_path):
    r = run(spark, write(tmp_path, [x.split(",", 1)[1] for x in lines(range(24))], "timestamp,kwh,circuit_type"))
    b = r.batches.first()
    assert b.overall_status == "quarantined" and b.total_rows == 0 and "missing_columns" in types(r)


def raw(spark, rows):
    return spark.createDataFrame(rows, "circuit_id string, ts timestamp, kwh double")


T0 = dt.datetime(2026, 1, 15)


def at(h, m=0):
    return T0 + dt.timedelta(hours=h, minutes=m)


def test_last_hour_on_the_hour(spark):
    r = raw(spark, [("c", at(h), 1.0) for h in range(6)])
    assert resample.hourly_grid(r, ["circuit_id"]).count() == 6
    assert resample.hourly_grid(r, ["circuit_id"], GateConfig(legacy_grid=True)).count() == 5


def test_leading_trailing_and_empty_series(spark):
    rows = [("a", at(0), None), ("a", at(1), 2.0), ("a", at(2), None), ("e", at(0), None), ("e", at(3), None)]
    g = {(r.circuit_id, r.ts.hour): r for r in resample.hourly_grid(raw(spark, rows), ["circuit_id"]).collect()}
    assert [g["a", h].kwh for h in range(3)] == [None, 2.0, None]
    assert len([k for k in g if k[0] == "e"]) == 4 and g["e", 0].gap_minutes == 240


def test_duplicate_rows_of_an_hour_are_summed(spark):
    r = raw(spark, [("c", at(0, 5), 1.0), ("c", at(0, 5), 1.0), ("c", at(0, 50), 2.5)])
    assert resample.hourly_grid(r, ["circuit_id"]).first().kwh == 4.5


def test_dropout_slots_match_brute_force(spark):
    import random

    rng = random.Random(3)
    stamps = sorted(at(0) + dt.timedelta(minutes=rng.uniform(0, 60 * 24 * 5)) for _ in range(250))
    df = raw(spark, [("c", s, 1.0) for s in stamps]).withColumn("ingestion_source", F.lit("smart_meter_api"))
    want = {(a, b) for a, b in zip(stamps, stamps[1:]) if (b - a).total_seconds() / 60 > 45}
    got = {(r.ts_start, r.ts_end) for r in faults.dropout_issues(df, ["circuit_id"]).collect()}
    assert got == want and want


def test_issue_scopes(spark):
    readings = spark.createDataFrame(
        [("t", "b", "u", c, at(h), "pass") for c in "xy" for h in range(3)],
        "tenant_id string, building_id string, batch_id string, circuit_id string, ts timestamp, data_quality_status string",
    )
    keys = "tenant_id string, building_id string, batch_id string, circuit_id string, severity string, ts_start timestamp, ts_end timestamp"
    spans = spark.createDataFrame([("t", "b", "u", "x", "degraded", at(0, 30), at(1)), ("t", "b", "u", "x", "quarantined", at(2), None)], keys)
    whole = spark.createDataFrame([("t", "b", "u", "y", "quarantined", None, None)], keys)
    out = gate.apply_issues(readings, spans, circuits=whole)
    got = {(r.circuit_id, r.ts.hour): r.data_quality_status for r in out.collect()}
    assert [got["x", h] for h in range(3)] == ["pass", "degraded", "quarantined"]
    assert {got["y", h] for h in range(3)} == {"quarantined"}


def test_bounds_fall_back_and_json(spark, tmp_path):
    none = spark.createDataFrame([("hvac", 0.0, 9.0, False)], "circuit_type string, min_kwh double, max_kwh double, is_active boolean")
    assert {r.circuit_type for r in active_bounds(none).collect()} == {r.circuit_type for r in built_in_bounds(spark).collect()}
    p = tmp_path / "b.json"
    p.write_text('{"circuit_type_bounds": {"hvac": {"min_kwh": 1, "max_kwh": 2}}, "default_bounds": {"min_kwh": 0, "max_kwh": 7}}')
    assert {(r.circuit_type, r.max_kwh) for r in bounds_from_json(spark, str(p)).collect()} == {("hvac", 2.0), ("__default__", 7.0)}


def test_tenant_scope_refuses_other_tables(spark):
    from wattloom.operators.scope import tenant_scope

    with pytest.raises(ValueError):
        tenant_scope(spark.range(1), "t")
