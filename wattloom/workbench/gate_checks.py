"""Quality-gate queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.config import GateConfig
from wattloom.operators import faults, gate, resample
from wattloom.sources.bounds import built_in_bounds
from wattloom.sources.presets import alias_table, expectation_table, resolve_manifest
from wattloom.workbench import sql, views
from wattloom.workbench.views import plain

SERIES = ["tenant_id", "building_id", "batch_id", "circuit_id", "circuit_type", "ingestion_source"]


def hourly_resample(spark, sf_dir):
    h = resample.hourly_sums(views.raw_meters(spark, sf_dir), ["tenant_id", "building_id", "circuit_id"])
    return plain(h.select("tenant_id", "building_id", "circuit_id", "ts", "kwh", "raw_rows"))


def _grid(spark, sf_dir, cfg=GateConfig()):
    return resample.hourly_grid(views.raw_meters(spark, sf_dir), SERIES, cfg)


def hourly_grid_fill(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return plain(g.select("circuit_id", "ts", "kwh", "filled", "gap_start", "gap_end", "gap_minutes", "raw_rows"))


def hourly_grid_unfilled(spark, sf_dir):
    g = _grid(spark, sf_dir, GateConfig(gap_fill="none"))
    return plain(g.select("circuit_id", "ts", "kwh"))


def gap_islands(spark, sf_dir):
    return plain(resample.gap_issues(_grid(spark, sf_dir), ["circuit_id"]))


def rolling_outliers(spark, sf_dir):
    s = faults.outlier_scores(_grid(spark, sf_dir), SERIES)
    return plain(s.select("circuit_id", "ts", F.round("zscore", 6).alias("zscore"), "is_outlier"))


def dropouts(spark, sf_dir):
    d = faults.dropout_issues(views.user_meters(spark, sf_dir), ["circuit_id"])
    return plain(d.select("circuit_id", "issue_type", "severity", "ts_start", "ts_end", "description"))


def _coarse(spark, sf_dir):
    """Hourly sums in steps of forty kWh, so that flat runs occur."""
    h = resample.hourly_sums(views.raw_meters(spark, sf_dir), ["circuit_id", "circuit_type"])
    return h.withColumn("kwh", F.floor(F.col("kwh") / 400) * 400.0)


def stuck_sensors(spark, sf_dir):
    s = faults.stuck_issues(_coarse(spark, sf_dir), ["circuit_id"])
    return plain(s.select("circuit_id", "issue_type", "severity", "ts_start", "ts_end", "description"))


def plausibility_bounds(spark, sf_dir):
    r = views.readings(spark, sf_dir).withColumn("kwh", F.col("kwh") - 5.0)
    tight = built_in_bounds(spark).withColumn("max_kwh", F.col("max_kwh") / 20)
    b = gate.bounds_issues(gate.with_bounds(r, tight), ["circuit_id"])
    return plain(b.select("circuit_id", "issue_type", "severity", "ts_start", "ts_end"))


def manifests(spark, sf_dir):
    """One manifest per user: the column set varies with the user."""
    u = F.col("user_id")
    cols = (
        F.when(u % 7 == 0, F.array(*map(F.lit, ("meter_id", "timestamp", "kwh"))))
        .when(u % 7 == 1, F.array(*map(F.lit, ("Meter_ID ", "ts", "reading", "kWh", "circuit_type"))))
        .when(u % 7 == 2, F.array(*map(F.lit, ("meter_id", "kwh", "note"))))
        .when(u % 7 == 3, F.array(*map(F.lit, ("timestamp", "kwh", "circuit_type"))))
        .when(u % 7 == 4, F.array(*map(F.lit, ("building_id", "meter", "timestamp", "meter_reading"))))
        .otherwise(F.array(*map(F.lit, ("meter_id", "timestamp", "kwh", "circuit_type"))))
    )
    return (
        views.table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(
            F.concat(F.lit("t"), F.floor(u / 100).cast("string")).alias("tenant_id"),
            F.concat(F.lit("b"), F.floor(u / 50).cast("string")).alias("building_id"),
            F.concat(F.lit("m"), u.cast("string")).alias("batch_id"),
            F.when(u % 7 == 4, "bdg2").when(u % 3 == 0, "combed").when(u % 3 == 1, "default").otherwise("elsewhere").alias("source_id"),
            cols.alias("columns"),
            "n_rows",
        )
    )


def _resolved(spark, sf_dir):
    return resolve_manifest(manifests(spark, sf_dir), alias_table(spark))


def column_aliases(spark, sf_dir):
    return _resolved(spark, sf_dir).select("batch_id", "source_id", "column", "raw_column")


def missing_columns(spark, sf_dir):
    return gate.missing_columns(manifests(spark, sf_dir), _resolved(spark, sf_dir))


def schema_drift(spark, sf_dir):
    return gate.schema_drift(manifests(spark, sf_dir), expectation_table(spark))


def schema_fingerprints(spark, sf_dir):
    types = F.create_map(F.lit("Kwh"), F.lit("numeric"), F.lit("meter_id"), F.lit("string"))
    m = manifests(spark, sf_dir)
    return m.select(
        "batch_id",
        gate.schema_fingerprint(F.col("columns")).alias("names_only"),
        gate.schema_fingerprint(F.col("columns"), types).alias("with_types"),
    )


def unmapped_meters(spark, sf_dir):
    raw = views.raw_meters(spark, sf_dir).withColumn(
        "meter_id", F.when(F.col("event_id") % 10 == 0, F.concat("circuit_id", F.lit("-x"))).otherwise(F.col("circuit_id"))
    )
    return gate.unmapped_circuits(raw, views.circuits(spark, sf_dir))


def interval_issues_applied(spark, sf_dir):
    """Dropouts of sparse meters, laid over their hourly readings."""
    raw = views.user_meters(spark, sf_dir)
    keys = ["circuit_id"]
    hours = resample.hourly_sums(raw, keys).withColumn("data_quality_status", F.lit("pass"))
    out = gate.apply_issues(hours, faults.dropout_issues(raw, keys), keys)
    return plain(out.select("circuit_id", "ts", "data_quality_status"))


def _drift_by_building(spark, sf_dir):
    """Every third building's upload carries an unexpected column."""
    b = views.raw_meters(spark, sf_dir).select(*gate.BATCH).distinct()
    n = F.substring("building_id", 2, 9).cast("int")
    return b, b.filter(n % 3 == 1).select(
        *gate.BATCH,
        F.lit("schema_drift").alias("issue_type"),
        F.lit("degraded").alias("severity"),
        F.lit("unexpected column").alias("description"),
    )


def _gate(spark, sf_dir):
    batches, drift = _drift_by_building(spark, sf_dir)
    return gate.quality_gate(views.raw_meters(spark, sf_dir), batches, built_in_bounds(spark), drift)


def quality_gate_readings(spark, sf_dir):
    r = _gate(spark, sf_dir).readings
    return plain(r.select("tenant_id", "building_id", "circuit_id", "ts", "kwh", "is_peak_hour", "filled", "data_quality_status", "schema_version", "normalization_version"))


def quality_gate_batches(spark, sf_dir):
    return _gate(spark, sf_dir).batches


def quality_gate_issues(spark, sf_dir):
    i = _gate(spark, sf_dir).issues
    return i.groupBy("building_id", "issue_type", "severity").agg(
        F.count(F.lit(1)).alias("n_issues"), F.countDistinct("circuit_id").alias("n_circuits")
    )


def fill_ratio(spark, sf_dir):
    r = gate.fill_ratio(_grid(spark, sf_dir))
    return r.select("batch_id", "interpolated", "valued", F.round("ratio", 6).alias("ratio"))


def gate_verdict(spark, sf_dir):
    return gate.gate_verdict(views.readings(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        hourly_resample, hourly_grid_fill, hourly_grid_unfilled, gap_islands, rolling_outliers, dropouts,
        stuck_sensors, plausibility_bounds, column_aliases, missing_columns, schema_drift, schema_fingerprints,
        unmapped_meters, interval_issues_applied, quality_gate_readings, quality_gate_batches,
        quality_gate_issues, fill_ratio, gate_verdict,
    )
}

_MANIFESTS = """manifests AS (
  SELECT 't'||(user_id//100) AS tenant_id, 'b'||(user_id//50) AS building_id, 'm'||user_id AS batch_id,
         CASE WHEN user_id % 7 = 4 THEN 'bdg2' WHEN user_id % 3 = 0 THEN 'combed' WHEN user_id % 3 = 1 THEN 'default' ELSE 'elsewhere' END AS source_id,
         CASE user_id % 7 WHEN 0 THEN ['meter_id','timestamp','kwh'] WHEN 1 THEN ['Meter_ID ','ts','reading','kWh','circuit_type']
              WHEN 2 THEN ['meter_id','kwh','note'] WHEN 3 THEN ['timestamp','kwh','circuit_type']
              WHEN 4 THEN ['building_id','meter','timestamp','meter_reading']
              ELSE ['meter_id','timestamp','kwh','circuit_type'] END AS cols
  FROM events GROUP BY user_id)"""

_CANON = """cols AS (SELECT batch_id, source_id, unnest(cols) AS raw_column, generate_subscripts(cols, 1) AS pos FROM manifests),
canon AS (SELECT *, lower(trim(raw_column)) AS k FROM cols),
named AS (SELECT batch_id, source_id, raw_column, pos,
  CASE WHEN source_id = 'bdg2' THEN
         CASE WHEN k IN ('meter_id','building_id','meter','circuit_id') THEN 'circuit_id'
              WHEN k IN ('timestamp','ts','time','datetime') THEN 'ts'
              WHEN k IN ('kwh','meter_reading','reading') THEN 'kwh'
              WHEN k IN ('circuit_type','meter_type') THEN 'circuit_type' ELSE raw_column END
       ELSE CASE WHEN k IN ('meter_id','meterid','device_id','sensor_id','circuit_id') OR (source_id = 'combed' AND k = 'panel') THEN 'circuit_id'
              WHEN k IN ('timestamp','ts','time','datetime','reading_time') OR (source_id = 'combed' AND k = 'date & time') THEN 'ts'
              WHEN k IN ('kwh','energy_kwh','consumption','reading') OR (source_id = 'combed' AND k IN ('power (kw)','power_kw')) THEN 'kwh'
              WHEN k IN ('circuit_type','circuittype','type','meter_type','device_type') THEN 'circuit_type' ELSE raw_column END
  END AS canonical FROM canon),
resolved AS (SELECT batch_id, source_id, canonical AS "column", arg_max(raw_column, pos) AS raw_column FROM named GROUP BY ALL)"""

_GATE = sql.SCORED + """,
flat AS (
  SELECT circuit_id, circuit_type, ts, kwh, row_number() OVER w AS n,
         CASE WHEN circuit_type IN ('lighting','plug_load') THEN 8 ELSE 6 END AS size,
         CASE WHEN circuit_type IN ('lighting','plug_load') THEN var_pop(kwh) OVER f8 ELSE var_pop(kwh) OVER f6 END AS v,
         CASE WHEN circuit_type IN ('lighting','plug_load') THEN first_value(ts) OVER f8 ELSE first_value(ts) OVER f6 END AS t0
  FROM grid WHERE kwh IS NOT NULL
  WINDOW w AS (PARTITION BY circuit_id ORDER BY ts), f8 AS (PARTITION BY circuit_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
         f6 AS (PARTITION BY circuit_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
still AS (SELECT *, n - row_number() OVER (PARTITION BY circuit_id ORDER BY ts) AS run FROM flat
          WHERE n >= size AND v <= CASE circuit_type WHEN 'hvac' THEN 1e-5 WHEN 'lighting' THEN 1e-5 WHEN 'plug_load' THEN 1e-4 ELSE 1e-6 END),
stuck AS (SELECT circuit_id, circuit_type, min(t0) AS a, max(ts) AS b FROM still GROUP BY circuit_id, circuit_type, run
          HAVING epoch(max(ts)) - epoch(min(t0)) >= 3600 * CASE circuit_type WHEN 'main_feed' THEN 4 WHEN 'lighting' THEN 8 WHEN 'plug_load' THEN 12 ELSE 6 END),
steps AS (SELECT circuit_id, lag(ts) OVER (PARTITION BY circuit_id ORDER BY ts) AS a, ts AS b FROM raw),
drops AS (SELECT circuit_id, a, b FROM steps WHERE epoch_us(b) - epoch_us(a) > 180 * 60000000::BIGINT),
ratio AS (SELECT batch_id, sum(greatest(hours - circuit_raw_rows, 0)) AS interpolated, sum(hours) AS valued
          FROM (SELECT batch_id, circuit_id, count(kwh) AS hours, max(circuit_raw_rows) AS circuit_raw_rows FROM grid GROUP BY ALL) GROUP BY ALL),
judged AS (
  SELECT s.*,
    greatest(
      CASE WHEN s.gap_minutes > 120 THEN 2 ELSE 0 END,
      CASE WHEN s.kwh < 0 OR s.kwh > CASE s.circuit_type WHEN 'hvac' THEN 2000 WHEN 'lighting' THEN 500 WHEN 'plug_load' THEN 200 ELSE 5000 END THEN 2 ELSE 0 END,
      CASE WHEN abs(s.zscore) > 3 THEN 1 ELSE 0 END,
      CASE WHEN CAST(substr(s.building_id, 2) AS INT) % 3 = 1 THEN 1 ELSE 0 END,
      CASE WHEN EXISTS (SELECT 1 FROM ratio r WHERE r.batch_id = s.batch_id AND r.interpolated / r.valued > 0.10) THEN 1 ELSE 0 END,
      coalesce((SELECT max(CASE WHEN k.circuit_type = 'main_feed' THEN 2 ELSE 1 END) FROM stuck k WHERE k.circuit_id = s.circuit_id AND s.ts BETWEEN k.a AND k.b), 0),
      CASE WHEN EXISTS (SELECT 1 FROM drops d WHERE d.circuit_id = s.circuit_id AND s.ts BETWEEN d.a AND d.b) THEN 1 ELSE 0 END
    ) AS rank
  FROM scored s),
final AS (SELECT *, CASE rank WHEN 0 THEN 'pass' WHEN 1 THEN 'degraded' ELSE 'quarantined' END AS data_quality_status FROM judged)"""

ORACLES = {
    "hourly_resample": f"WITH {sql.HOURLY} SELECT tenant_id, building_id, circuit_id, ts, kwh, raw_rows FROM hourly",
    "hourly_grid_fill": f"WITH {sql.GRID} SELECT circuit_id, ts, kwh, filled, gap_start, gap_end, gap_minutes, raw_rows FROM grid",
    "hourly_grid_unfilled": f"WITH {sql.GRID} SELECT circuit_id, ts, CASE WHEN NOT filled THEN kwh END AS kwh FROM grid",
    "gap_islands": f"""WITH {sql.GRID} SELECT circuit_id, 'gap_beyond_bound' AS issue_type, 'quarantined' AS severity,
        gap_start AS ts_start, gap_end AS ts_end,
        'Gap of '||gap_minutes||' minutes exceeds max_interpolation_gap_minutes=120' AS description FROM gaps WHERE gap_minutes > 120""",
    "rolling_outliers": f"WITH {sql.SCORED} SELECT circuit_id, ts, round(zscore, 6) AS zscore, abs(zscore) > 3 AS is_outlier FROM scored",
    "dropouts": f"""WITH {sql.USERS}, steps AS (
        SELECT circuit_id, ingestion_source, lag(ts) OVER (PARTITION BY circuit_id ORDER BY ts) AS ts_start, ts AS ts_end,
               CASE ingestion_source WHEN 'smart_meter_api' THEN 15 ELSE 60 END AS expected FROM users)
        SELECT circuit_id, 'dropout' AS issue_type, 'degraded' AS severity, ts_start, ts_end,
               'Reporting gap of '||CAST(round_even((epoch_us(ts_end) - epoch_us(ts_start)) / 60000000, 0) AS BIGINT)||' min exceeds '||(expected * 3)
               ||' min (3.0x expected '||expected||' min for '||ingestion_source||')' AS description
        FROM steps WHERE (epoch_us(ts_end) - epoch_us(ts_start)) / 60000000 > expected * 3""",
    "stuck_sensors": f"""WITH {sql.HOURLY}, grid AS (SELECT circuit_id, circuit_type, ts, floor(kwh / 400) * 400.0 AS kwh FROM hourly),
        flat AS (
          SELECT circuit_id, circuit_type, ts, kwh, row_number() OVER w AS n,
                 CASE WHEN circuit_type IN ('lighting','plug_load') THEN 8 ELSE 6 END AS size,
                 CASE WHEN circuit_type IN ('lighting','plug_load') THEN var_pop(kwh) OVER f8 ELSE var_pop(kwh) OVER f6 END AS v,
                 CASE WHEN circuit_type IN ('lighting','plug_load') THEN first_value(ts) OVER f8 ELSE first_value(ts) OVER f6 END AS t0,
                 CASE WHEN circuit_type IN ('lighting','plug_load') THEN first_value(kwh) OVER f8 ELSE first_value(kwh) OVER f6 END AS k0
          FROM grid WINDOW w AS (PARTITION BY circuit_id ORDER BY ts),
               f8 AS (PARTITION BY circuit_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
               f6 AS (PARTITION BY circuit_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
        still AS (SELECT *, n - row_number() OVER (PARTITION BY circuit_id ORDER BY ts) AS run FROM flat
          WHERE n >= size AND v <= CASE circuit_type WHEN 'hvac' THEN 1e-5 WHEN 'lighting' THEN 1e-5 WHEN 'plug_load' THEN 1e-4 ELSE 1e-6 END),
        runs AS (SELECT circuit_id, circuit_type, min(t0) AS ts_start, max(ts) AS ts_end, arg_min(k0, ts) AS k0,
                 CASE circuit_type WHEN 'main_feed' THEN 4 WHEN 'lighting' THEN 8 WHEN 'plug_load' THEN 12 ELSE 6 END AS lim
          FROM still GROUP BY circuit_id, circuit_type, run)
        SELECT circuit_id, 'stuck_at_value' AS issue_type, CASE circuit_type WHEN 'main_feed' THEN 'quarantined' ELSE 'degraded' END AS severity,
               ts_start, ts_end,
               printf('Stuck at %.2f kWh for %.1fh (threshold: %dh for %s)', k0, (epoch(ts_end) - epoch(ts_start)) / 3600, lim, circuit_type) AS description
        FROM runs WHERE (epoch(ts_end) - epoch(ts_start)) / 3600 >= lim""",
    "plausibility_bounds": f"""WITH {sql.READINGS} SELECT circuit_id, 'implausible_value' AS issue_type, 'quarantined' AS severity, ts AS ts_start, ts AS ts_end
        FROM readings WHERE kwh - 5 < 0 OR kwh - 5 > CASE circuit_type WHEN 'hvac' THEN 100 WHEN 'lighting' THEN 25 WHEN 'plug_load' THEN 10 ELSE 250 END""",
    "column_aliases": f'WITH {_MANIFESTS}, {_CANON} SELECT batch_id, source_id, "column", raw_column FROM resolved',
    "missing_columns": f"""WITH {_MANIFESTS}, {_CANON}, have AS (SELECT batch_id, list("column") AS h FROM resolved GROUP BY ALL)
        SELECT m.tenant_id, m.building_id, m.batch_id, 'missing_columns' AS issue_type, 'quarantined' AS severity,
          CASE WHEN NOT list_contains(h, 'ts') OR NOT list_contains(h, 'kwh') THEN 'Required columns missing after mapping: '
               || concat_ws(', ', CASE WHEN NOT list_contains(h, 'kwh') THEN 'kwh' END, CASE WHEN NOT list_contains(h, 'ts') THEN 'ts' END)
               ELSE 'No circuit identifier column found after mapping' END AS description
        FROM manifests m JOIN have USING (batch_id)
        WHERE NOT (list_contains(h, 'ts') AND list_contains(h, 'kwh') AND list_contains(h, 'circuit_id'))""",
    "schema_drift": f"""WITH {_MANIFESTS},
        e AS (SELECT *, list_transform(cols, lambda x: lower(trim(x))) AS have,
                CASE WHEN source_id IN ('combed','bdg2') THEN ['meter_id','timestamp','kwh'] ELSE ['meter_id','timestamp','kwh','circuit_type'] END AS want FROM manifests),
        d AS (SELECT *, list_sort(list_filter(want, lambda x: NOT list_contains(have, x))) AS missing,
                list_sort(list_distinct(list_filter(have, lambda x: NOT list_contains(want, x)))) AS extra FROM e),
        r AS (SELECT *, list_filter(missing, lambda x: x <> 'circuit_type') AS fatal FROM d)
        SELECT tenant_id, building_id, batch_id, 'schema_drift' AS issue_type,
          CASE WHEN len(fatal) > 0 THEN 'quarantined' ELSE 'degraded' END AS severity,
          CASE WHEN len(fatal) > 0 THEN 'Required columns missing for source '''||source_id||''': ['''||array_to_string(fatal, ''', ''')||''']'
               ELSE 'Schema drift detected for source '''||source_id||''': '||concat_ws(', ',
                 CASE WHEN len(missing) > 0 THEN 'missing=['''||array_to_string(missing, ''', ''')||''']' END,
                 CASE WHEN len(extra) > 0 THEN 'unexpected=['''||array_to_string(extra, ''', ''')||''']' END) END AS description
        FROM r WHERE len(missing) > 0 OR len(extra) > 0""",
    "schema_fingerprints": f"""WITH {_MANIFESTS}, n AS (SELECT batch_id, '{{"columns": ["'||array_to_string(list_sort(list_transform(cols, lambda x: lower(trim(x)))), '", "')||'"]' AS b FROM manifests)
        SELECT batch_id, substr(sha256(b||'}}'), 1, 16) AS names_only,
               substr(sha256(b||', "types": {{"kwh": "numeric", "meter_id": "string"}}}}'), 1, 16) AS with_types FROM n""",
    "unmapped_meters": f"""WITH {sql.RAW} SELECT DISTINCT tenant_id, building_id, batch_id, 'unmapped_circuit' AS issue_type, 'quarantined' AS severity,
        'Raw meter ID '''||circuit_id||'-x'' not found in circuit_map' AS description FROM raw WHERE event_id % 10 = 0""",
    "interval_issues_applied": f"""WITH {sql.USERS}, h AS (SELECT DISTINCT circuit_id, ingestion_source, date_trunc('hour', ts) AS ts FROM users),
        steps AS (SELECT circuit_id, lag(ts) OVER (PARTITION BY circuit_id ORDER BY ts) AS a, ts AS b,
                  CASE ingestion_source WHEN 'smart_meter_api' THEN 45 ELSE 180 END AS lim FROM users),
        drops AS (SELECT * FROM steps WHERE (epoch_us(b) - epoch_us(a)) / 60000000 > lim)
        SELECT h.circuit_id, h.ts, CASE WHEN EXISTS (SELECT 1 FROM drops d WHERE d.circuit_id = h.circuit_id AND h.ts BETWEEN d.a AND d.b)
               THEN 'degraded' ELSE 'pass' END AS data_quality_status FROM h""",
    "quality_gate_readings": f"""WITH {_GATE} SELECT tenant_id, building_id, circuit_id, ts, kwh, hour(ts) BETWEEN 9 AND 18 AS is_peak_hour, filled,
        data_quality_status, 'normalized_reading_v1' AS schema_version, 'v1.0.0' AS normalization_version FROM final""",
    "quality_gate_batches": f"""WITH {_GATE} SELECT tenant_id, building_id, batch_id, count(*) AS total_rows, count(*) FILTER (rank = 0) AS pass_count,
        count(*) FILTER (rank = 1) AS degraded_count, count(*) FILTER (rank = 2) AS quarantined_count,
        CASE WHEN min(rank) = 2 THEN 'quarantined' WHEN max(rank) = 0 THEN 'pass' ELSE 'degraded' END AS overall_status FROM final GROUP BY ALL""",
    "quality_gate_issues": f"""WITH {_GATE}, i AS (
        SELECT building_id, circuit_id, 'outlier' AS issue_type, 'degraded' AS severity FROM scored WHERE abs(zscore) > 3
        UNION ALL SELECT building_id, circuit_id, 'implausible_value', 'quarantined' FROM scored
          WHERE kwh < 0 OR kwh > CASE circuit_type WHEN 'hvac' THEN 2000 WHEN 'lighting' THEN 500 WHEN 'plug_load' THEN 200 ELSE 5000 END
        UNION ALL SELECT split_part(circuit_id, '-', 1), circuit_id, 'gap_beyond_bound', 'quarantined' FROM gaps WHERE gap_minutes > 120
        UNION ALL SELECT split_part(circuit_id, '-', 1), circuit_id, 'stuck_at_value', CASE circuit_type WHEN 'main_feed' THEN 'quarantined' ELSE 'degraded' END FROM stuck
        UNION ALL SELECT split_part(circuit_id, '-', 1), circuit_id, 'dropout', 'degraded' FROM drops
        UNION ALL SELECT substr(batch_id, 3), NULL, 'high_interpolation_ratio', 'degraded' FROM ratio WHERE interpolated / valued > 0.10
        UNION ALL SELECT DISTINCT building_id, NULL, 'schema_drift', 'degraded' FROM raw WHERE CAST(substr(building_id, 2) AS INT) % 3 = 1)
        SELECT building_id, issue_type, severity, count(*) AS n_issues, count(DISTINCT circuit_id) AS n_circuits FROM i GROUP BY ALL""",
    "fill_ratio": f"""WITH {_GATE} SELECT batch_id, CAST(interpolated AS BIGINT) AS interpolated, CAST(valued AS BIGINT) AS valued,
        round(interpolated / valued, 6) AS ratio FROM ratio""",
    "gate_verdict": f"""WITH {sql.READINGS}, c AS (SELECT tenant_id, building_id, count(*) FILTER (data_quality_status = 'pass') AS n_pass,
        count(*) FILTER (data_quality_status = 'degraded') AS n_degraded, count(*) FILTER (data_quality_status = 'quarantined') AS n_quarantined
        FROM readings GROUP BY ALL)
        SELECT *, CASE WHEN n_pass + n_degraded = 0 THEN 'stop' WHEN n_degraded > 0 THEN 'degraded' ELSE 'pass' END AS verdict FROM c""",
}
