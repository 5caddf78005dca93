"""Common table expressions that mirror `views.py` in plain SQL."""

TYPE_CASE = (
    "CASE event_type WHEN 'click' THEN 'hvac' WHEN 'view' THEN 'plug_load' WHEN 'purchase' THEN 'main_feed' "
    "WHEN 'signup' THEN 'lighting' ELSE 'unlisted' END"
)

RAW = f"""raw AS (
  SELECT 't'||(user_id//100) AS tenant_id, 'b'||(user_id//50) AS building_id, 'u-b'||(user_id//50) AS batch_id,
         'b'||(user_id//50)||'-'||event_type AS circuit_id, {TYPE_CASE} AS circuit_type,
         event_id, ts, value AS kwh
  FROM events)"""

HOURLY = RAW + """,
hourly AS (
  SELECT tenant_id, building_id, batch_id, circuit_id, circuit_type, date_trunc('hour', ts) AS ts,
         round(sum(kwh), 6) AS kwh, count(*) AS raw_rows
  FROM raw GROUP BY ALL)"""

READINGS = HOURLY + """,
readings AS (
  SELECT tenant_id, building_id, circuit_id, circuit_type, ts, kwh,
         CASE WHEN kwh > 250 THEN 'quarantined' WHEN kwh > 150 THEN 'degraded' ELSE 'pass' END AS data_quality_status
  FROM hourly)"""

GRID = HOURLY + """,
span AS (SELECT tenant_id, building_id, batch_id, circuit_id, circuit_type, min(ts) AS lo, max(ts) AS hi,
                sum(raw_rows) AS circuit_raw_rows FROM hourly GROUP BY ALL),
slots AS (SELECT tenant_id, building_id, batch_id, circuit_id, circuit_type, circuit_raw_rows,
                 unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span),
dense AS (SELECT s.*, h.kwh AS obs, coalesce(h.raw_rows, 0) AS raw_rows
          FROM slots s LEFT JOIN hourly h ON h.circuit_id = s.circuit_id AND h.ts = s.ts),
marked AS (SELECT *, count(obs) OVER (PARTITION BY circuit_id ORDER BY ts) AS isl FROM dense),
gaps AS (SELECT circuit_id, isl, min(ts) AS gap_start, max(ts) + INTERVAL 1 HOUR AS gap_end, count(*) * 60 AS gap_minutes
         FROM marked WHERE obs IS NULL GROUP BY ALL),
grid AS (
  SELECT m.tenant_id, m.building_id, m.batch_id, m.circuit_id, m.circuit_type, m.ts, m.raw_rows, m.circuit_raw_rows,
         g.gap_start, g.gap_end, g.gap_minutes,
         coalesce(m.obs IS NULL AND g.gap_minutes <= 120 AND a.kwh IS NOT NULL AND z.kwh IS NOT NULL, false) AS filled,
         CASE WHEN m.obs IS NOT NULL THEN m.obs
              WHEN g.gap_minutes <= 120 THEN round(a.kwh + (z.kwh - a.kwh)
                * ((epoch_us(m.ts) - epoch_us(a.ts)) / (epoch_us(z.ts) - epoch_us(a.ts))), 6) END AS kwh
  FROM marked m
  LEFT JOIN gaps g ON m.obs IS NULL AND g.circuit_id = m.circuit_id AND g.isl = m.isl
  LEFT JOIN hourly a ON a.circuit_id = g.circuit_id AND a.ts = g.gap_start - INTERVAL 1 HOUR
  LEFT JOIN hourly z ON z.circuit_id = g.circuit_id AND z.ts = g.gap_end)"""

SCORED = GRID + """,
valued AS (
  SELECT circuit_id, ts, kwh,
         count(*) OVER (PARTITION BY circuit_id) AS n_all,
         count(*) OVER f AS n, avg(kwh) OVER f AS mu, stddev_samp(kwh) OVER f AS sd
  FROM grid WHERE kwh IS NOT NULL
  WINDOW f AS (PARTITION BY circuit_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
scored AS (
  SELECT g.*, CASE WHEN v.n_all >= 24 AND v.n >= 12 AND v.sd > 0 THEN (v.kwh - v.mu) / v.sd ELSE 0.0 END AS zscore
  FROM grid g LEFT JOIN valued v ON v.circuit_id = g.circuit_id AND v.ts = g.ts)"""

USERS = """users AS (
  SELECT 't'||(user_id//100) AS tenant_id, 'b'||(user_id//50) AS building_id, 'u'||user_id AS circuit_id,
         CASE WHEN user_id % 2 = 0 THEN 'smart_meter_api' ELSE 'csv_upload' END AS ingestion_source,
         event_type, event_id, ts, value AS kwh FROM events)"""

CIRCUITS = """circuits AS (
  SELECT DISTINCT 't'||(user_id//100) AS tenant_id, 'b'||(user_id//50) AS building_id,
         'b'||(user_id//50)||'-'||event_type AS circuit_id, """ + TYPE_CASE + """ AS circuit_type FROM events)"""

BUILDINGS = """buildings AS (
  SELECT 't'||(s_suppkey//2) AS tenant_id, 'b'||s_suppkey AS building_id, s_name AS name,
         CASE s_suppkey % 3 WHEN 0 THEN 'office' WHEN 1 THEN 'retail' ELSE 'hotel' END AS building_type,
         CASE s_suppkey % 2 WHEN 0 THEN 'warm' ELSE 'composite' END AS climate_zone,
         s_suppkey % 4 = 3 AS cold_start,
         CASE WHEN s_suppkey % 5 <> 4 THEN 20.0 + (s_suppkey % 7) * 5.0 END::DOUBLE AS declared_unoccupied_baseline,
         s_suppkey % 6 <> 5 AS has_schedule,
         CASE WHEN s_suppkey % 3 <> 2 THEN 9.0 + (s_suppkey % 4) * 0.5 END::DOUBLE AS peak_rate,
         CASE WHEN s_suppkey % 3 <> 1 THEN 5.0 + (s_suppkey % 5) * 0.25 END::DOUBLE AS offpeak_rate,
         CASE WHEN s_suppkey % 4 <> 2 THEN 4000.0 + (s_suppkey % 10) * 3000.0 END::DOUBLE AS rooftop_area_sqm,
         CASE WHEN s_suppkey % 7 <> 6 THEN s_nationkey * 2.0 - 10.0 END::DOUBLE AS latitude,
         CASE WHEN s_suppkey % 7 <> 6 THEN 77.0 END::DOUBLE AS longitude,
         TIMESTAMP '2023-01-01 00:00:00' + (s_suppkey % 50) * INTERVAL 1 DAY AS onboarded_at
  FROM supplier)"""

FINDINGS = """findings AS (
  SELECT 'f'||o_orderkey AS finding_id, 't'||(o_custkey//1000) AS tenant_id, 'b'||(o_custkey//500) AS building_id,
         'b'||(o_custkey//500)||'-'||(['click','view','purchase','signup','error'])[o_custkey % 5 + 1] AS circuit_id,
         CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'ml_ensemble' ELSE 'domain_rule' END AS layer_origin,
         CASE o_orderpriority WHEN '3-MEDIUM' THEN 'hvac_after_hours_v3' WHEN '4-NOT SPECIFIED' THEN 'weekend_vampire_load_v1'
              WHEN '5-LOW' THEN 'other_rule_v1' END AS rule_id,
         o_orderdate AS detected_at,
         CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'dismissed' ELSE 'open' END AS status,
         CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice / 600000, 8) END AS confidence,
         round(o_totalprice / 100000 - 2.5, 7) AS anomaly_score
  FROM orders)"""

LABELS = """labels_fb AS (
  SELECT 'l-'||l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey AS feedback_id, 'f'||l_orderkey AS finding_id,
         CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'R' THEN 'dismissed' ELSE 'noted' END AS action,
         l_shipdate AS created_at FROM lineitem)"""
