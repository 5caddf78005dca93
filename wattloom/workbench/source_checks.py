"""Source, sink, scope and lookup queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.config import GateConfig
from wattloom.functions import scalars as S
from wattloom.operators import gate, scope
from wattloom.operators import rules as rule_ops
from wattloom.session import shared_path, store_table
from wattloom.sinks import merge, messages, records
from wattloom.sources import bounds, calendars, meters, presets, rules
from wattloom.workbench import gate_checks, sql, views
from wattloom.workbench.views import plain

def _as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def meter_csv_lines(spark, sf_dir):
    """Events written as CSV lines, some cut short or with unreadable numbers, parsed back."""
    e = views.table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kwh = F.when(F.col("event_id") % 11 == 0, "n/a").when(F.col("event_id") % 13 == 0, "nan").otherwise(F.col("value").cast("decimal(12,2)").cast("string"))
    line = F.when(F.col("event_id") % 17 == 0, F.concat_ws(",", "event_type", stamp)).otherwise(
        F.concat(F.concat_ws(",", "event_type", stamp, kwh), F.lit(",hvac"))
    )
    lines = e.select("event_id", F.when(F.col("event_id") == 0, F.concat(F.lit(meters.BOM), line)).otherwise(line).alias("line"))
    parsed = meters.parse_csv_lines(lines, "line", ["meter_id", "timestamp", "kwh", "circuit_type"])
    typed = gate.normalize_rows(presets.resolve_columns(parsed, presets.preset("default")).withColumn("source_timezone", F.lit("Asia/Kolkata")))
    return plain(typed.select("event_id", "circuit_id", "ts", "kwh", "circuit_type"))


def wide_meter_unpivot(spark, sf_dir):
    """Hourly columns per meter back to long rows; empty cells vanish."""
    e = views.table(spark, sf_dir, "events")
    kinds = list(views.TYPE_OF)
    wide = e.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("timestamp")).pivot("event_type", kinds).agg(F.round(F.sum("value"), 6))
    keyed = wide.withColumn("timestamp", F.concat_ws("|", F.col("user_id").cast("string"), F.col("timestamp").cast("string"))).drop("user_id")
    return meters.wide_to_long(keyed, "timestamp", kinds).select("meter_id", "timestamp", "kwh")


def push_payload_rows(spark, sf_dir):
    u = views.user_meters(spark, sf_dir)
    payload = meters.push_payload(
        F.col("circuit_id").alias("meter_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        "kwh", F.col("event_type").alias("circuit_type"),
    )
    rows = meters.push_rows(u.select("event_id", payload.alias("value")))
    return plain(rows.select("event_id", "meter_id", S.to_utc("timestamp", "UTC").alias("ts"), "kwh", "circuit_type"))


def timestamp_zones(spark, sf_dir):
    """Stamps with and without offsets, in two source zones, plus unreadable ones."""
    e = views.table(spark, sf_dir, "events")
    i = F.col("event_id")
    base = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    txt = (
        F.when(i % 5 == 0, F.concat(base, F.lit("+05:30"))).when(i % 5 == 1, F.concat(F.replace(base, F.lit(" "), F.lit("T")), F.lit("Z")))
        .when(i % 5 == 2, F.lit("not a time")).otherwise(base)
    )
    zone = F.when(i % 2 == 0, "Asia/Kolkata").otherwise("UTC")
    return plain(e.select("event_id", S.to_utc(txt, zone).alias("ts")))


def dropout_stamps(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    i = F.col("event_id")
    raw = e.select(
        F.when(i % 7 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("circuit_id"),
        S.to_utc(F.when(i % 6 == 0, "?").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "UTC").alias("ts"),
    )
    return gate.raw_stamps(raw).groupBy("circuit_id").agg(F.count(F.lit(1)).alias("n_stamps"))


def source_presets(spark, sf_dir):
    """Preset per batch of each source with the number of raw rows it stands for."""
    m = gate_checks.manifests(spark, sf_dir)
    j = presets.with_preset(m, presets.expectation_table(spark))
    return j.groupBy("source_id").agg(
        F.sum("n_rows").alias("n_rows"), F.first(F.array_join("expected", ",")).alias("expected"),
        F.first(F.array_join("required", ",")).alias("required"),
    )


def holiday_and_closure_sources(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    hol = o.select(
        F.when(F.col("o_orderstatus") == "F", "IN").otherwise("US").alias("country"), F.to_date("o_orderdate").alias("date"),
        F.concat(F.lit("day "), F.col("o_orderpriority")).alias("name"),
    )
    h = calendars.holidays_of(hol, "IN", 1997)
    c = calendars.closure_rows(o.filter("o_orderstatus <> 'F'").select(
        F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(F.col("o_orderkey") % 3 == 0, "  ").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).alias("description"),
    ))
    return h.unionByName(c.select("date", "source")).groupBy("date", "source").agg(F.count(F.lit(1)).alias("n"))


def bounds_table(spark, sf_dir):
    """Active rows of a bounds table kept on parts; readings joined to what is active."""
    p = views.table(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(x) for x in ("hvac", "lighting", "plug_load", "main_feed", "__default__")])
    rows = p.groupBy(F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")).alias("circuit_type")).agg(
        F.lit(0.0).alias("min_kwh"), F.max(F.col("p_size") * 1.0).alias("max_kwh")
    ).withColumn("is_active", F.col("circuit_type") != "lighting")
    r = gate.with_bounds(views.readings(spark, sf_dir), bounds.active_bounds(rows))
    return r.groupBy("circuit_type").agg(F.max("max_kwh").alias("max_kwh"), F.count_if(gate.implausible()).alias("n_outside"))


def rule_versions(spark, sf_dir):
    """Candidate rules against versions already registered per rule."""
    f = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 50).cast("string")).alias("rule_id"), (F.col("o_orderkey") % 9).cast("int").alias("version"), "o_orderstatus"
    )
    return rules.check_versions(f.filter("o_orderstatus <> 'F'").drop("o_orderstatus").distinct(), f.filter("o_orderstatus = 'F'")).select(
        "rule_id", "version", "registered_version", "accepted"
    )


def readings_upsert(spark, sf_dir):
    """Stored hours merged with re-delivered ones: only kWh and status change."""
    u = views.user_meters(spark, sf_dir)
    k = ["tenant_id", "circuit_id"]
    hours = u.groupBy(*k, S.hour_floor("ts").alias("ts"), (F.col("event_id") % 3).alias("batch_seq")).agg(S.stable_sum("kwh").alias("kwh"))
    current = hours.filter("batch_seq = 0").select(*k, "ts", "kwh", F.lit("pass").alias("data_quality_status"), F.lit("first").alias("source_system"))
    incoming = hours.filter("batch_seq > 0").select(*k, "ts", "kwh", F.lit("degraded").alias("data_quality_status"), F.concat(F.lit("again-"), F.col("batch_seq").cast("string")).alias("source_system"), "batch_seq")
    return plain(merge.upsert(current, incoming, update=merge.READING_VALUES))


def findings_round_trip(spark, sf_dir):
    """Rule findings appended to files with a JSON bundle, in two runs, and read back typed."""
    # both runs read the findings, which are worked out once
    found = store_table(records.finding_records(rule_ops.rule_findings(rule_ops.fired(views.readings(spark, sf_dir), views.buildings(spark, sf_dir)))), "found")
    path, early = shared_path(spark, "findings"), F.hour("detected_at") < 12
    for part in (found.filter(early), found.filter(~early)):
        merge.append_files(part, path)
    back = records.read_findings(spark.read.schema(found.schema).parquet(path))
    b = F.col("bundle")
    return plain(back.select(
        "tenant_id", "building_id", "circuit_id", "layer_origin", "evidence_start", "evidence_end", "status",
        b["rule_citations"][0]["rule_id"].alias("rule_id"), b["rule_citations"][0]["version"].cast("long").alias("version"),
        b["evidence_window"]["start"].alias("window_start"), F.array_join(b["contributing_layers"], ",").alias("layers"),
        (b["finding_id"] == F.col("finding_id")).alias("same_id"),
    ))


def _rollups(spark, sf_dir):
    """Batch verdicts as the manifests' drift would leave them."""
    m = gate_checks.manifests(spark, sf_dir)
    d = gate.schema_drift(m, presets.expectation_table(spark))
    worst = d.select("batch_id", "severity")
    b = m.join(worst, "batch_id", "left").select(
        "tenant_id", "building_id", "batch_id", F.lit("csv_upload").alias("ingestion_source"),
        F.coalesce("severity", F.lit("pass")).alias("overall_status"), F.col("n_rows").alias("total_rows"),
        F.when(F.col("severity") == "quarantined", F.col("n_rows")).otherwise(0).alias("quarantined_count"),
        F.when(F.col("severity").isNull(), F.col("n_rows")).otherwise(0).alias("pass_count"),
        F.when(F.col("severity") == "degraded", F.col("n_rows")).otherwise(0).alias("degraded_count"),
    )
    return b, d


def quality_alerts(spark, sf_dir):
    return messages.quality_alerts(*_rollups(spark, sf_dir))


def data_arrived_events(spark, sf_dir):
    out = messages.data_arrived(_rollups(spark, sf_dir)[0], _as_of())
    return out.select("key", F.regexp_replace("value", '"event_id":"[0-9a-f]+"', '"event_id":"*"').alias("value"))


def batch_lookup(spark, sf_dir):
    b = records.batch_records(_rollups(spark, sf_dir)[0], _as_of())
    return plain(scope.lookup(b, "t0", batch_id="m7"))


def model_versions(spark, sf_dir):
    """Version numbers for new training runs, after those already registered."""
    return plain(records.register_versions(*_runs(spark, sf_dir)).select("tenant_id", "building_id", "model_type", "run_id", "version"))


def _runs(spark, sf_dir):
    f = views.findings(spark, sf_dir).select(
        "tenant_id", "building_id", F.col("layer_origin").alias("model_type"), F.col("finding_id").alias("run_id"),
        F.col("detected_at").alias("trained_at"), "status",
    )
    done = f.filter("status = 'confirmed'").drop("status")
    old = records.register_versions(done, done.limit(0).withColumn("version", F.lit(0).cast("long")))
    return f.filter("status <> 'confirmed'").drop("status"), old


def latest_model_runs(spark, sf_dir):
    return records.latest_runs(_runs(spark, sf_dir)[1])


def circuit_registry(spark, sf_dir):
    u = views.user_meters(spark, sf_dir).select(
        "tenant_id", "building_id", F.col("circuit_id").alias("meter_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("circuit_type"),
        "ts", F.col("event_id").alias("seq"),
    )
    n = F.substring("meter_id", 2, 9).cast("int")
    known = u.filter(n % 4 == 0).select(
        F.concat(F.lit("k"), F.col("meter_id")).alias("circuit_id"), "tenant_id", "building_id", F.col("meter_id").alias("label"), F.lit("hvac").alias("circuit_type")
    ).distinct()
    out = records.get_or_create_circuits(u, known)
    return out.select("tenant_id", "building_id", "label", "circuit_type", F.col("circuit_id").startswith("k").alias("known"))


def audit_entries(spark, sf_dir):
    f = views.findings(spark, sf_dir)
    return records.audit_rows(f, F.concat(F.lit("finding."), F.col("status")), [F.col("building_id"), F.col("rule_id")], F.col("finding_id"))


def ingest_summary(spark, sf_dir):
    """Rows and verdicts per source: the whole gate in one job, then sums."""
    from wattloom.plans.ingest import dataset_summary

    raw = views.raw_meters(spark, sf_dir)
    b = raw.select(*gate.BATCH).distinct().withColumn("source_id", F.lit("combed"))
    return dataset_summary(gate.quality_gate(raw, b, bounds.built_in_bounds(spark), None, GateConfig(gap_fill="none")))


def tenant_readings(spark, sf_dir):
    return plain(scope.tenant_scope(views.readings(spark, sf_dir), "t0"))


def usable_window(spark, sf_dir):
    a, z = (F.lit(x).cast("timestamp") for x in ("2024-01-05 00:00:00", "2024-01-20 12:00:00"))
    return plain(scope.usable_window(views.readings(spark, sf_dir), a, z).select("circuit_id", "ts", "kwh", "data_quality_status"))


def findings_page(spark, sf_dir):
    f = scope.list_findings(views.findings(spark, sf_dir), "t0", status="open", min_confidence=0.3, limit=100, offset=20)
    return plain(f.select("finding_id", "building_id", "confidence", "detected_at"))


def building_lookup(spark, sf_dir):
    b = scope.lookup(views.buildings(spark, sf_dir), "t1", building_id="b3")
    return plain(b.select("tenant_id", "building_id", "name", "building_type", "declared_unoccupied_baseline", "onboarded_at"))


def newest_buildings(spark, sf_dir):
    b = views.buildings(spark, sf_dir).select("building_id", "onboarded_at")
    return plain(scope.newest_first(b, "onboarded_at", "building_id"))


def rule_context(spark, sf_dir):
    r = scope.building_context(views.readings(spark, sf_dir), views.buildings(spark, sf_dir).filter("building_id <> 'b0'"))
    return r.groupBy("building_id").agg(F.max("building.declared_unoccupied_baseline").alias("baseline"), F.max(F.col("building.occupancy_schedule").isNotNull()).alias("has_schedule"))


def drift_context(spark, sf_dir):
    r = views.readings(spark, sf_dir).groupBy("tenant_id", "building_id").agg(F.count(F.lit(1)).alias("n"))
    return scope.drift_context(r, views.buildings(spark, sf_dir).filter("building_id <> 'b1'"))


def status_domain(spark, sf_dir):
    f = views.findings(spark, sf_dir).withColumn("data_quality_status", F.when(F.col("status") == "open", "pass").when(F.col("status") == "confirmed", "fine"))
    return scope.domain_violations(f).groupBy("building_id").agg(F.count(F.lit(1)).alias("n"))


def bundle_contract(spark, sf_dir):
    """Bundles of findings, some broken on purpose by their own columns."""
    f = views.findings(spark, sf_dir)
    layer = F.when(F.col("status") == "dismissed", "guess").otherwise(F.col("layer_origin"))
    band = F.when(F.col("confidence").isNotNull(), F.struct((F.col("confidence") + 0.1).alias("lower"), F.lit(0.6).alias("upper"), F.lit("conformal_prediction").alias("method")))
    cites = F.when(F.col("rule_id").isNotNull(), F.array(F.struct(F.col("rule_id"), F.lit(1).alias("version"), F.lit("c").alias("citation")))).otherwise(
        F.array().cast("array<struct<rule_id:string,version:int,citation:string>>"))
    top = F.array().cast("array<struct<feature:string,shap_value:double,plain_language:string>>")
    b = F.struct("finding_id", F.array(layer).alias("contributing_layers"), top.alias("top_features"), cites.alias("rule_citations"),
                 band.alias("confidence_band"), F.struct(F.col("detected_at").alias("start"), F.col("detected_at").alias("end")).alias("evidence_window"))
    v = scope.bundle_violations(f.withColumn("bundle", b))
    return v.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        meter_csv_lines, wide_meter_unpivot, push_payload_rows, timestamp_zones, dropout_stamps, source_presets,
        holiday_and_closure_sources, bounds_table, rule_versions, readings_upsert, findings_round_trip, quality_alerts,
        data_arrived_events, batch_lookup, model_versions, latest_model_runs, circuit_registry, audit_entries,
        ingest_summary, tenant_readings, usable_window, findings_page, building_lookup, newest_buildings, rule_context,
        drift_context, status_domain, bundle_contract,
    )
}

FIRES = f"""{sql.READINGS}, {sql.BUILDINGS},
ctx AS (SELECT r.*, coalesce(b.declared_unoccupied_baseline, 0) AS base,
          coalesce(b.has_schedule AND isodow(r.ts) BETWEEN 1 AND 5 AND CAST(r.ts AS TIME) BETWEEN TIME '08:00:00' AND TIME '18:00:00', false) AS occupied
        FROM readings r LEFT JOIN buildings b ON b.building_id = r.building_id AND b.tenant_id = r.tenant_id
        WHERE data_quality_status <> 'quarantined'),
fires AS (
  SELECT *, 'hvac_after_hours_v3' AS rule_id, 3 AS version FROM ctx WHERE circuit_type = 'hvac' AND kwh > base * 1.4 AND NOT occupied
  UNION ALL SELECT *, 'scheduling_violation_v1', 1 FROM ctx WHERE circuit_type = 'main_feed' AND kwh > base * 1.5 AND NOT occupied
  UNION ALL SELECT *, 'weekend_vampire_load_v1', 1 FROM ctx WHERE circuit_type = 'plug_load' AND kwh > base * 1.2 AND NOT occupied AND isodow(ts) IN (6, 7))"""

_ROLL = f"""{gate_checks._MANIFESTS},
e AS (SELECT tenant_id, building_id, batch_id, source_id, list_transform(cols, lambda x: lower(trim(x))) AS have,
        CASE WHEN source_id IN ('combed','bdg2') THEN ['meter_id','timestamp','kwh'] ELSE ['meter_id','timestamp','kwh','circuit_type'] END AS want FROM manifests),
s AS (SELECT *, list_filter(want, lambda x: NOT list_contains(have, x)) AS missing, list_filter(have, lambda x: NOT list_contains(want, x)) AS extra FROM e),
n AS (SELECT 'm'||user_id AS batch_id, count(*) AS n_rows FROM events GROUP BY 1),
roll AS (SELECT s.*, n.n_rows, CASE WHEN len(list_filter(missing, lambda x: x <> 'circuit_type')) > 0 THEN 'quarantined'
           WHEN len(missing) > 0 OR len(extra) > 0 THEN 'degraded' ELSE 'pass' END AS overall_status
         FROM s JOIN n USING (batch_id))"""

_RUNS = f"""{sql.FINDINGS}, runs AS (SELECT tenant_id, building_id, layer_origin AS model_type, finding_id AS run_id, detected_at AS trained_at, status FROM findings),
old AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, building_id, model_type ORDER BY trained_at, run_id) AS version FROM runs WHERE status = 'confirmed')"""

ORACLES = {
    "meter_csv_lines": """SELECT event_id, event_type AS circuit_id, date_trunc('second', ts) - INTERVAL 330 MINUTE AS ts,
        CASE WHEN event_id % 17 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS kwh,
        CASE WHEN event_id % 17 <> 0 THEN 'hvac' END AS circuit_type FROM events""",
    "wide_meter_unpivot": """SELECT event_type AS meter_id, user_id||'|'||strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS "timestamp", round(sum(value), 6) AS kwh
        FROM events GROUP BY event_type, user_id, date_trunc('day', ts)""",
    "push_payload_rows": """SELECT event_id, 'u'||user_id AS meter_id, date_trunc('second', ts) AS ts, value AS kwh, event_type AS circuit_type FROM events""",
    "timestamp_zones": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE WHEN 1 THEN date_trunc('second', ts)
        WHEN 2 THEN NULL ELSE date_trunc('second', ts) - CASE WHEN event_id % 2 = 0 THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END END AS ts FROM events""",
    "dropout_stamps": "SELECT 'u'||user_id AS circuit_id, count(*) AS n_stamps FROM events WHERE event_id % 7 <> 0 AND event_id % 6 <> 0 GROUP BY 1",
    "source_presets": f"""WITH {gate_checks._MANIFESTS}, n AS (SELECT 'm'||user_id AS batch_id, count(*) AS n_rows FROM events GROUP BY 1)
        SELECT source_id, CAST(sum(n_rows) AS BIGINT) AS n_rows, CASE WHEN source_id IN ('combed','bdg2') THEN 'meter_id,timestamp,kwh' ELSE 'meter_id,timestamp,kwh,circuit_type' END AS expected,
        'meter_id,timestamp,kwh' AS required FROM manifests JOIN n USING (batch_id) GROUP BY source_id""",
    "holiday_and_closure_sources": """SELECT date, source, count(*) AS n FROM (
        SELECT CAST(o_orderdate AS DATE) AS date, 'holiday_api:IN:day '||o_orderpriority AS source FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1997
        UNION ALL SELECT CAST(o_orderdate AS DATE), CASE WHEN o_orderkey % 3 = 1 THEN 'customer_upload:'||o_orderpriority ELSE 'customer_upload' END FROM orders WHERE o_orderstatus <> 'F')
        GROUP BY ALL""",
    "bounds_table": f"""WITH {sql.READINGS}, bt AS (SELECT (['hvac','lighting','plug_load','main_feed','__default__'])[p_partkey % 5 + 1] AS circuit_type, max(p_size)::DOUBLE AS hi FROM part GROUP BY 1)
        SELECT r.circuit_type, max(coalesce(b.hi, d.hi)) AS max_kwh, count(*) FILTER (r.kwh < 0 OR r.kwh > coalesce(b.hi, d.hi)) AS n_outside
        FROM readings r LEFT JOIN bt b ON b.circuit_type = r.circuit_type AND b.circuit_type <> 'lighting' CROSS JOIN (SELECT hi FROM bt WHERE circuit_type = '__default__') d
        GROUP BY r.circuit_type""",
    "rule_versions": """WITH f AS (SELECT 'r'||(o_custkey % 50) AS rule_id, CAST(o_orderkey % 9 AS INT) AS version, o_orderstatus FROM orders),
        reg AS (SELECT rule_id, max(version) AS registered_version FROM f WHERE o_orderstatus = 'F' GROUP BY 1)
        SELECT DISTINCT f.rule_id, version, registered_version, coalesce(version >= registered_version, true) AS accepted
        FROM f LEFT JOIN reg USING (rule_id) WHERE o_orderstatus <> 'F'""",
    "readings_upsert": f"""WITH {sql.USERS}, h AS (SELECT tenant_id, circuit_id, date_trunc('hour', ts) AS ts, event_id % 3 AS seq, round(sum(kwh), 6) AS kwh FROM users GROUP BY ALL),
        last AS (SELECT * FROM h WHERE seq > 0 QUALIFY row_number() OVER (PARTITION BY tenant_id, circuit_id, ts ORDER BY seq DESC) = 1),
        cur AS (SELECT * FROM h WHERE seq = 0)
        SELECT tenant_id, circuit_id, ts, coalesce(l.kwh, c.kwh) AS kwh, CASE WHEN l.kwh IS NULL THEN 'pass' ELSE 'degraded' END AS data_quality_status,
               CASE WHEN c.kwh IS NOT NULL THEN 'first' ELSE 'again-'||l.seq END AS source_system
        FROM cur c FULL JOIN last l USING (tenant_id, circuit_id, ts)""",
    "findings_round_trip": f"""WITH {FIRES} SELECT tenant_id, building_id, circuit_id, 'domain_rule' AS layer_origin, ts AS evidence_start, ts AS evidence_end,
        'open' AS status, rule_id, CAST(version AS BIGINT) AS version, ts AS window_start, 'domain_rule' AS layers, true AS same_id FROM fires""",
    "quality_alerts": f"""WITH {_ROLL}, txt AS ({gate_checks.ORACLES['schema_drift'].replace('WITH ' + gate_checks._MANIFESTS + ',', 'WITH ')})
        SELECT roll.tenant_id, roll.building_id, roll.batch_id, CASE overall_status WHEN 'quarantined' THEN 'quarantined_batch' ELSE 'schema_drift' END AS alert_type,
          CASE overall_status WHEN 'quarantined' THEN 'critical' ELSE 'warning' END AS severity,
          CASE overall_status WHEN 'quarantined' THEN 'Entire batch quarantined: '||n_rows||' rows. No downstream analysis triggered. Issues: 1'
               ELSE 'Schema drift detected in ingestion batch: '||txt.description||'. Data accepted as degraded — review source schema.' END AS message,
          CASE overall_status WHEN 'quarantined' THEN '{{"total_rows":"'||n_rows||'","quarantined_count":"'||n_rows||'","issue_types":"schema_drift"}}'
               ELSE '{{"drift_count":"1","data_quality_status":"degraded"}}' END AS metadata
        FROM roll JOIN txt USING (batch_id) WHERE overall_status <> 'pass'""",
    "data_arrived_events": f"""WITH {_ROLL} SELECT tenant_id AS key, '{{"event_id":"*","tenant_id":"'||tenant_id||'","building_id":"'||building_id||'","correlation_id":"'||batch_id
        ||'","timestamp":"2024-02-01T00:00:00+00:00","event_type":"building.data.arrived","data_quality_status":"'||overall_status||'","batch_row_count":'||n_rows||',"ingestion_source":"csv_upload"}}' AS value
        FROM roll WHERE overall_status <> 'quarantined'""",
    "batch_lookup": f"""WITH {_ROLL} SELECT batch_id, tenant_id, building_id, overall_status, n_rows AS total_rows,
        CASE overall_status WHEN 'pass' THEN n_rows ELSE 0 END AS pass_count, CASE overall_status WHEN 'degraded' THEN n_rows ELSE 0 END AS degraded_count,
        CASE overall_status WHEN 'quarantined' THEN n_rows ELSE 0 END AS quarantined_count, TIMESTAMP '2024-02-01' AS created_at FROM roll WHERE tenant_id = 't0' AND batch_id = 'm7'""",
    "model_versions": f"""WITH {_RUNS}, top AS (SELECT tenant_id, building_id, model_type, max(version) AS m FROM old GROUP BY ALL)
        SELECT r.tenant_id, r.building_id, r.model_type, r.run_id, coalesce(m, 0) + row_number() OVER (PARTITION BY r.tenant_id, r.building_id, r.model_type ORDER BY trained_at, run_id) AS version
        FROM runs r LEFT JOIN top USING (tenant_id, building_id, model_type) WHERE status <> 'confirmed'""",
    "latest_model_runs": f"""WITH {_RUNS} SELECT tenant_id, building_id, model_type, run_id, version FROM old
        QUALIFY row_number() OVER (PARTITION BY tenant_id, building_id, model_type ORDER BY trained_at DESC, run_id DESC) = 1""",
    "circuit_registry": f"""WITH {sql.USERS}, f AS (SELECT tenant_id, building_id, circuit_id AS label, event_type, ts, event_id FROM users)
        SELECT tenant_id, building_id, label, CASE WHEN CAST(substr(label, 2) AS INT) % 4 = 0 THEN 'hvac' ELSE
          coalesce((array_agg(CASE WHEN event_type <> 'error' THEN event_type END ORDER BY ts, event_id))[1], 'main_feed') END AS circuit_type,
          CAST(substr(label, 2) AS INT) % 4 = 0 AS known FROM f GROUP BY tenant_id, building_id, label""",
    "audit_entries": f"""WITH {sql.FINDINGS} SELECT tenant_id, 'finding.'||status AS event_type, finding_id AS entity_id,
        '{{"building_id":"'||building_id||'","rule_id":'||coalesce('"'||rule_id||'"', 'null')||'}}' AS payload FROM findings""",
    "tenant_readings": f"WITH {sql.READINGS} SELECT * FROM readings WHERE tenant_id = 't0'",
    "usable_window": f"""WITH {sql.READINGS} SELECT circuit_id, ts, kwh, data_quality_status FROM readings
        WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00' AND data_quality_status <> 'quarantined'""",
    "findings_page": f"""WITH {sql.FINDINGS} SELECT finding_id, building_id, confidence, detected_at FROM findings
        WHERE tenant_id = 't0' AND status = 'open' AND confidence >= 0.3 ORDER BY detected_at DESC, finding_id LIMIT 100 OFFSET 20""",
    "building_lookup": f"WITH {sql.BUILDINGS} SELECT tenant_id, building_id, name, building_type, declared_unoccupied_baseline, onboarded_at FROM buildings WHERE tenant_id = 't1' AND building_id = 'b3'",
    "newest_buildings": f"WITH {sql.BUILDINGS} SELECT building_id, onboarded_at FROM buildings ORDER BY onboarded_at DESC, building_id",
    "rule_context": f"""WITH {sql.READINGS}, {sql.BUILDINGS} SELECT r.building_id, max(coalesce(CASE WHEN r.building_id <> 'b0' THEN b.declared_unoccupied_baseline END, 0)) AS baseline,
        bool_or(coalesce(r.building_id <> 'b0' AND b.has_schedule, false)) AS has_schedule FROM readings r LEFT JOIN buildings b USING (tenant_id, building_id) GROUP BY r.building_id""",
    "drift_context": f"""WITH {sql.READINGS}, {sql.BUILDINGS}, n AS (SELECT tenant_id, building_id, count(*) AS n FROM readings GROUP BY ALL)
        SELECT n.tenant_id, n.building_id, n.n, coalesce(CASE WHEN n.building_id <> 'b1' THEN building_type END, 'office') AS building_type,
        CASE WHEN n.building_id <> 'b1' THEN climate_zone END AS climate_zone FROM n LEFT JOIN buildings USING (tenant_id, building_id)""",
    "status_domain": f"WITH {sql.FINDINGS} SELECT building_id, count(*) AS n FROM findings WHERE status <> 'open' GROUP BY 1",
    "bundle_contract": f"""WITH {sql.FINDINGS}, t AS (SELECT concat_ws(',', CASE WHEN status = 'dismissed' THEN 'unknown_layer' END,
          CASE WHEN status <> 'dismissed' AND layer_origin = 'ml_ensemble' AND rule_id IS NOT NULL THEN 'ml_only_with_citation' END,
          CASE WHEN status = 'dismissed' OR layer_origin = 'ml_ensemble' THEN 'no_top_features' END,
          CASE WHEN (status = 'dismissed' OR layer_origin = 'ml_ensemble') AND confidence IS NULL THEN 'no_confidence_band' END,
          CASE WHEN confidence + 0.1 > 0.6 THEN 'band_order' END, CASE WHEN confidence + 0.1 < 0 THEN 'band_range' END) AS violations FROM findings)
        SELECT violations, count(*) AS n FROM t WHERE violations <> '' GROUP BY 1""",
}
ORACLES["ingest_summary"] = f"""WITH {sql.HOURLY}, span AS (SELECT batch_id, circuit_id, circuit_type, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY ALL),
    g AS (SELECT s.*, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span s),
    d AS (SELECT g.batch_id, g.circuit_id, g.circuit_type, g.ts, h.kwh FROM g LEFT JOIN hourly h ON h.circuit_id = g.circuit_id AND h.ts = g.ts),
    i AS (SELECT *, count(kwh) OVER (PARTITION BY circuit_id ORDER BY ts) AS isl FROM d),
    gp AS (SELECT *, CASE WHEN kwh IS NULL THEN count(*) OVER (PARTITION BY circuit_id, isl, kwh IS NULL) END AS len FROM i),
    z AS (SELECT circuit_id, ts, abs(kwh - avg(kwh) OVER f) > 3 * stddev_samp(kwh) OVER f AND count(*) OVER f >= 12 AND count(*) OVER (PARTITION BY circuit_id) >= 24 AS outl
          FROM hourly WINDOW f AS (PARTITION BY circuit_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
    steps AS (SELECT circuit_id, lag(ts) OVER (PARTITION BY circuit_id ORDER BY ts) AS a, ts AS b FROM raw),
    drops AS (SELECT * FROM steps WHERE epoch_us(b) - epoch_us(a) > 10800000000),
    j AS (SELECT gp.batch_id, greatest(CASE WHEN len > 2 THEN 2 ELSE 0 END,
            CASE WHEN kwh > CASE circuit_type WHEN 'hvac' THEN 2000 WHEN 'lighting' THEN 500 WHEN 'plug_load' THEN 200 ELSE 5000 END THEN 2 ELSE 0 END,
            CASE WHEN outl THEN 1 ELSE 0 END,
            CASE WHEN EXISTS (SELECT 1 FROM drops WHERE drops.circuit_id = gp.circuit_id AND gp.ts BETWEEN a AND b) THEN 1 ELSE 0 END) AS rank
          FROM gp LEFT JOIN z ON z.circuit_id = gp.circuit_id AND z.ts = gp.ts),
    per AS (SELECT batch_id, count(*) AS n, count(*) FILTER (rank = 0) AS p, count(*) FILTER (rank = 1) AS dg, count(*) FILTER (rank = 2) AS q FROM j GROUP BY 1)
    SELECT 'combed' AS source_id, count(*) AS n_batches, CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(p) AS BIGINT) AS pass_count,
           CAST(sum(dg) AS BIGINT) AS degraded_count, CAST(sum(q) AS BIGINT) AS quarantined_count, count(*) FILTER (q = n) AS quarantined_batches FROM per"""
