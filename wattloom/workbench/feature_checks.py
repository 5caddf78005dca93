"""Calendar, rule, feature, residual and drift queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattloom.config import DriftConfig, GateConfig
from wattloom.operators import calendar, drift, features, ranking, resample, rules, stl
from wattloom.sinks import messages
from wattloom.sources import calendars
from wattloom.sources.rules import Rule
from wattloom.streaming import events
from wattloom.workbench import sql, views
from wattloom.workbench.source_checks import FIRES
from wattloom.workbench.views import plain

FIRST, LAST = "2024-01-01", "2024-01-31"


def _closures(spark, sf_dir):
    """One declared closure per building, on a day that follows its number."""
    b = views.table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    rows = b.select(
        F.concat(F.lit("t"), F.floor(n / 2).cast("string")).alias("tenant_id"), F.concat(F.lit("b"), n.cast("string")).alias("building_id"),
        F.date_add(F.lit(FIRST).cast("date"), (n % 28).cast("int")).cast("string").alias("date"), F.col("s_name").alias("description"),
    )
    return calendars.closure_rows(rows)


def _holidays(spark):
    rows = spark.createDataFrame([("IN", "2024-01-26", "Republic Day"), ("IN", "2024-01-15", "Harvest"), ("US", "2024-01-01", "New Year")], "country string, date string, name string")
    return calendars.holidays_of(rows.withColumn("date", F.to_date("date")), "IN", 2024)


def _calendar(spark, sf_dir):
    return calendar.build_calendar(views.buildings(spark, sf_dir), _holidays(spark), _closures(spark, sf_dir), FIRST, LAST)


def building_calendar(spark, sf_dir):
    return _calendar(spark, sf_dir)


def weekend_backfill(spark, sf_dir):
    c = _closures(spark, sf_dir).withColumn("day_type", F.lit("declared_closure"))
    grid = calendar.date_grid(views.buildings(spark, sf_dir), FIRST, LAST)
    return calendar.uncovered_weekends(grid, c)


def calendar_upsert(spark, sf_dir):
    base = calendar.entries(_closures(spark, sf_dir), "declared_closure", 0)
    later = calendar.entries(base.filter(F.dayofmonth("date") % 2 == 0).withColumn("source", F.lit("manual")), "holiday", 1)
    extra = calendar.entries(base.withColumns({"date": F.date_add("date", 1), "source": F.lit("manual")}), "holiday", 2)
    return calendar.upsert_calendar(base.drop("batch_seq"), later.unionByName(extra))


def _dated(spark, sf_dir):
    return calendar.with_day_type(views.readings(spark, sf_dir), _calendar(spark, sf_dir))


def day_types(spark, sf_dir):
    return plain(_dated(spark, sf_dir).select("circuit_id", "ts", "day_type"))


def uncovered_circuits(spark, sf_dir):
    """Circuits whose calendar misses a date are set aside as a whole."""
    holes = _calendar(spark, sf_dir).filter(~((F.substring("building_id", 2, 9).cast("int") % 3 == 1) & (F.dayofmonth("date") == 12)))
    kept, gaps = calendar.complete_circuits(calendar.with_day_type(views.readings(spark, sf_dir), holes))
    k = kept.groupBy("circuit_id").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("missing_date", F.lit(None).cast("date"))
    return k.unionByName(gaps.select("circuit_id", F.lit(0).cast("long").alias("n_rows"), "missing_date"))


def _fires(spark, sf_dir):
    return rules.fired(views.readings(spark, sf_dir), views.buildings(spark, sf_dir))


def rule_engine(spark, sf_dir):
    return plain(_fires(spark, sf_dir).select("tenant_id", "building_id", "circuit_id", "ts", "kwh", "rule_id", F.col("rule_version").cast("long").alias("version"), "severity"))


def rule_fire_maps(spark, sf_dir):
    m = rules.fire_maps(_fires(spark, sf_dir))
    return plain(m.select("circuit_id", "ts", F.array_join(F.map_keys("rule_fire_indicators"), ",").alias("rules")))


def _stand_in(spark, sf_dir):
    """Residual-like rows that SQL can restate: distance from the cohort mean."""
    d = _dated(spark, sf_dir)
    cohort = Window.partitionBy("circuit_id", "day_type")
    n = F.count(F.lit(1)).over(cohort)
    r = d.withColumn("stl_residual", F.round(F.col("kwh") - F.avg("kwh").over(cohort), 9)).withColumn("low_data_quality", n < 48)
    return r.withColumn("residual_magnitude", F.when(~F.col("low_data_quality"), F.abs("stl_residual")))


def robust_residual_scores(spark, sf_dir):
    s = stl.robust_scores(_stand_in(spark, sf_dir), ["circuit_id", "day_type"])
    return plain(s.select("circuit_id", "ts", "day_type", (F.round("residual_zscore", 6) + 0.0).alias("residual_zscore"), "is_anomalous"))


def cohort_sizes(spark, sf_dir):
    return stl.cohort_sizes(_dated(spark, sf_dir)).drop("tenant_id")


def seasonal_residuals(spark, sf_dir):
    kept, _ = calendar.complete_circuits(_dated(spark, sf_dir))
    return plain(stl.residuals(kept))


def residual_window_summary(spark, sf_dir):
    s = _stand_in(spark, sf_dir).withColumn("is_anomalous", F.col("residual_magnitude") > 100)
    return plain(stl.window_summary(s))


def carried_series(spark, sf_dir):
    g = resample.hourly_grid(views.raw_meters(spark, sf_dir), ["circuit_id"], GateConfig(gap_fill="none"))
    return plain(resample.carry_fill(g, ["circuit_id"]).select("circuit_id", "ts", "kwh"))


def _features(spark, sf_dir):
    return features.assemble(views.readings(spark, sf_dir), _stand_in(spark, sf_dir), rules.fire_maps(_fires(spark, sf_dir)))


def rolling_baseline(spark, sf_dir):
    f = features.rolling_features(views.readings(spark, sf_dir))
    names = ["weekend_floor_load", "rolling_efficiency_ratio"]
    return plain(f.select("circuit_id", "ts", "rolling_baseline_kwh", "peak_offpeak_split", "after_hours_kwh_ratio", *[F.round(n, 6).alias(n) for n in names]))


def volume_baseline(spark, sf_dir):
    """Trailing week over line items as meters: one circuit per supplier, stamps by ship date and line."""
    l = views.table(spark, sf_dir, "lineitem")
    ts = F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))
    r = resample.hourly_sums(
        l.select(F.lit("t").alias("tenant_id"), F.col("l_suppkey").cast("string").alias("circuit_id"), ts.alias("ts"), F.col("l_quantity").alias("kwh")), ["tenant_id", "circuit_id"]
    )
    f = features.rolling_features(r)
    return plain(f.select("circuit_id", "ts", "kwh", "rolling_baseline_kwh", F.round("weekend_floor_load", 6).alias("weekend_floor_load")))


def feature_set(spark, sf_dir):
    f = features.require_schema_version(_features(spark, sf_dir))
    return plain(f.select(
        "circuit_id", "ts", "rolling_baseline_kwh", "stl_residual_magnitude", "day_type",
        "low_data_quality", F.array_join(F.map_keys("rule_fire_indicators"), ",").alias("rules"), "feature_schema_version",
    ))


def feature_upsert(spark, sf_dir):
    """Feature rows stored, then replaced by a later assembly of half the circuits."""
    from wattloom.sinks.merge import upsert

    f = _features(spark, sf_dir).select("tenant_id", "circuit_id", "ts", "rolling_baseline_kwh", "day_type", "low_data_quality")
    later = f.filter(F.col("circuit_id").rlike("-(click|view)$")).withColumns({"day_type": F.lit("holiday"), "batch_seq": F.lit(1)})
    return plain(upsert(f, later))


def rule_layout(spark, sf_dir):
    r = features.rule_ids(_features(spark, sf_dir))
    return r.select("tenant_id", "building_id", F.array_join("rule_ids", ",").alias("rule_ids"), F.array_join(features.feature_names(F.col("rule_ids")), ",").alias("names"))


def _vectors(spark, sf_dir):
    return features.vectorize(features.with_rule_ids(_features(spark, sf_dir)))


def feature_vectors(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("circuit_id", "ts", F.posexplode("vector").alias("pos", "x"))
    return plain(v.select("circuit_id", "ts", F.col("pos").cast("long").alias("pos"), F.round("x", 9).alias("x")))


def scaler_parameters(spark, sf_dir):
    s = features.fit_scaler(_vectors(spark, sf_dir))
    return s.select("building_id", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"), "n")


def chronological_split(spark, sf_dir):
    s = features.chronological_split(views.readings(spark, sf_dir))
    return plain(s.select("building_id", "circuit_id", "ts", "position", "split"))


def global_split(spark, sf_dir):
    s = features.chronological_split(views.readings(spark, sf_dir), keys=[])
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))


def sliding_windows(spark, sf_dir):
    v = views.readings(spark, sf_dir).withColumn("vector", F.array("kwh", F.hour("ts").cast("double")))
    w = features.sliding_windows(v)
    return plain(w.select("circuit_id", "ts", "window_start", F.size("window").cast("long").alias("length"), F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.element_at("window", 1).alias("oldest")))


def exact_percentile(spark, sf_dir):
    q = ranking.exact_quantile(views.readings(spark, sf_dir), ["building_id"], "kwh", 0.95, "p95")
    return q.select("building_id", F.round("p95", 6).alias("p95"))


def exact_percentile_volume(spark, sf_dir):
    q = ranking.exact_quantile(views.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9, "p90")
    return q.select("l_returnflag", F.round("p90", 6).alias("p90"))


def _baselined(spark, sf_dir):
    return features.rolling_features(views.readings(spark, sf_dir))


def drift_results(spark, sf_dir):
    cfg = DriftConfig(overrides={"office:warm": (0.5, 10), "retail:default": (0.01, 5000)})
    d = drift.detect(_baselined(spark, sf_dir), views.buildings(spark, sf_dir), cfg)
    return d.withColumn("magnitude", F.round("magnitude", 9))


def _drift_stamp():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def drift_retraining(spark, sf_dir):
    """From drift verdicts over the event topic to retraining triggers; a second delivery of the topic starts nothing."""
    cfg = DriftConfig(overrides={"office:warm": (0.5, 10), "retail:default": (0.01, 5000)})
    d = drift.detect(_baselined(spark, sf_dir), views.buildings(spark, sf_dir), cfg)
    sent = messages.drift_detected(d, _drift_stamp())
    return events.triggers(events.of_topic(sent.unionByName(sent), events.DRIFTED), "drift")


def stale_baselines(spark, sf_dir):
    cfg = DriftConfig(overrides={"office:warm": (0.5, 10), "retail:default": (0.01, 5000)})
    d = drift.detect(_baselined(spark, sf_dir), views.buildings(spark, sf_dir), cfg)
    n = messages.stale_baseline_notices(d)
    return n.select("key", F.get_json_object("value", "$.tenant_id").alias("tenant_id"), F.get_json_object("value", "$.notification_type").alias("notification_type"))


def rule_errors(spark, sf_dir):
    """Rules whose conditions fail on some rows: those rows do not fire, all others do."""
    own = [
        Rule("zero_division_v1", 1, "1.0 / (hour(ts) % 3) > 0.6", "test"),
        Rule("bad_cast_v1", 1, "cast(if(hour(ts) % 2 = 0, '7', 'seven') as int) = 7", "test"),
        Rule("far_element_v1", 1, "array(0, 1)[hour(ts) % 4] = 1", "test"),
    ]
    f = rules.fired(views.readings(spark, sf_dir), views.buildings(spark, sf_dir), own)
    return plain(f.select("circuit_id", "ts", "rule_id"))


def trend_statistics(spark, sf_dir):
    t = drift.trend_statistics(drift.efficiency_ratios(_baselined(spark, sf_dir)))
    return t.select("building_id", "n", "s", F.round("z", 6).alias("z"), F.round("slope", 9).alias("slope"))


QUERIES = {
    f.__name__: f
    for f in (
        building_calendar, weekend_backfill, calendar_upsert, day_types, uncovered_circuits, rule_engine, rule_fire_maps,
        robust_residual_scores, cohort_sizes, seasonal_residuals, residual_window_summary, carried_series, rolling_baseline,
        volume_baseline, feature_set, feature_upsert, rule_layout, feature_vectors, scaler_parameters, chronological_split,
        global_split, sliding_windows, exact_percentile, exact_percentile_volume, drift_results, drift_retraining, stale_baselines, rule_errors, trend_statistics,
    )
}

_CLOSE = """closures AS (SELECT 't'||(s_suppkey//2) AS tenant_id, 'b'||s_suppkey AS building_id, CAST(DATE '2024-01-01' + CAST(s_suppkey % 28 AS INT) AS DATE) AS date,
    'customer_upload:'||s_name AS source FROM supplier)"""
_GRID = """days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS date),
    bgrid AS (SELECT 't'||(s_suppkey//2) AS tenant_id, 'b'||s_suppkey AS building_id, date FROM supplier CROSS JOIN days)"""
CALENDAR = f"""{_CLOSE}, {_GRID}, calendar AS (
    SELECT g.tenant_id, g.building_id, g.date,
      CASE WHEN c.date IS NOT NULL THEN 'declared_closure' WHEN g.date IN (DATE '2024-01-26', DATE '2024-01-15') THEN 'holiday' WHEN isodow(g.date) >= 6 THEN 'weekend' ELSE 'business_day' END AS day_type,
      CASE WHEN c.date IS NOT NULL THEN c.source WHEN g.date = DATE '2024-01-26' THEN 'holiday_api:IN:Republic Day' WHEN g.date = DATE '2024-01-15' THEN 'holiday_api:IN:Harvest'
           WHEN isodow(g.date) >= 6 THEN 'auto:weekday_check' ELSE 'auto:remainder' END AS source
    FROM bgrid g LEFT JOIN closures c USING (tenant_id, building_id, date))"""
DATED = f"""{sql.READINGS}, {CALENDAR}, dated AS (SELECT r.*, c.day_type FROM readings r LEFT JOIN calendar c ON c.building_id = r.building_id AND c.tenant_id = r.tenant_id AND c.date = CAST(r.ts AS DATE))"""
STAND_IN = f"""{DATED}, base AS (SELECT *, round(kwh - avg(kwh) OVER (PARTITION BY circuit_id, day_type), 9) AS stl_residual, count(*) OVER (PARTITION BY circuit_id, day_type) < 48 AS low_data_quality FROM dated),
    resid AS (SELECT *, CASE WHEN NOT low_data_quality THEN abs(stl_residual) END AS residual_magnitude FROM base)"""
_ROLLING = """rolled AS (SELECT *, round(avg(coalesce(kwh, 0)) OVER (PARTITION BY circuit_id ORDER BY ts RANGE BETWEEN INTERVAL 604799 SECOND PRECEDING AND CURRENT ROW), 9) AS baseline,
      avg(CASE WHEN isodow(ts) >= 6 AND NOT (hour(ts) >= 8 AND hour(ts) < 18) THEN kwh END) OVER (PARTITION BY circuit_id) AS we,
      coalesce(avg(CASE WHEN isodow(ts) < 6 AND NOT (hour(ts) >= 8 AND hour(ts) < 18) THEN kwh END) OVER (PARTITION BY circuit_id), 1.0) AS wd FROM {src})"""
ROLLED = f"{sql.READINGS}, " + _ROLLING.format(src="readings")
FEATURES = STAND_IN + ", " + _ROLLING.format(src="readings") + f""",
{sql.BUILDINGS},
{FIRES[FIRES.index('ctx AS'):]},
maps AS (SELECT circuit_id, ts, string_agg(rule_id, ',' ORDER BY rule_id) AS rules, list(rule_id) AS rl FROM fires GROUP BY ALL),
feats AS (SELECT r.tenant_id, r.building_id, r.circuit_id, r.ts, r.kwh, r.baseline AS rolling_baseline_kwh,
    CASE WHEN r.kwh <> 0 THEN CASE WHEN hour(r.ts) BETWEEN 9 AND 20 THEN 1.0 ELSE 0.0 END END AS peak,
    CASE WHEN hour(r.ts) >= 8 AND hour(r.ts) < 18 AND isodow(r.ts) < 6 THEN 0.0 ELSE 1.0 END AS after_hours,
    CASE WHEN isodow(r.ts) >= 6 AND wd <> 0 THEN we / wd END AS floor_load, CASE WHEN r.baseline > 0 THEN r.kwh / r.baseline END AS eff,
    s.residual_magnitude AS mag, coalesce(s.day_type, 'business_day') AS day_type, coalesce(s.low_data_quality, false) AS low_data_quality, coalesce(m.rules, '') AS rules, m.rl
  FROM rolled r LEFT JOIN resid s ON s.circuit_id = r.circuit_id AND s.ts = r.ts LEFT JOIN maps m ON m.circuit_id = r.circuit_id AND m.ts = r.ts),
lay AS (SELECT building_id, list_sort(list(DISTINCT x)) AS ids FROM (SELECT building_id, unnest(rl) AS x FROM feats) GROUP BY 1)"""
VECS = FEATURES + """,
vecs AS (SELECT f.building_id, f.circuit_id, f.ts, list_concat([coalesce(rolling_baseline_kwh, 0)::DOUBLE, coalesce(peak, 0)::DOUBLE, coalesce(after_hours, 0)::DOUBLE, coalesce(floor_load, 0)::DOUBLE, coalesce(eff, 0)::DOUBLE, coalesce(mag, 0)::DOUBLE,
    CASE day_type WHEN 'weekend' THEN 1 WHEN 'holiday' THEN 2 WHEN 'declared_closure' THEN 3 ELSE 0 END::DOUBLE],
    list_transform(coalesce(l.ids, []), lambda i: CASE WHEN list_contains(coalesce(f.rl, []), i) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS v
  FROM feats f LEFT JOIN lay l USING (building_id)),
longv AS (SELECT building_id, circuit_id, ts, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM vecs)"""
TREND = ROLLED + """,
ratios AS (SELECT building_id, round(kwh / baseline, 9) AS x, row_number() OVER (PARTITION BY building_id ORDER BY ts, circuit_id) AS p FROM rolled
  WHERE data_quality_status <> 'quarantined' AND baseline > 0),
pairs AS (SELECT a.building_id, sign(b.x - a.x) AS sg, (b.x - a.x) / (b.p - a.p) AS slope FROM ratios a JOIN ratios b ON a.building_id = b.building_id AND a.p < b.p),
ps AS (SELECT building_id, CAST(sum(sg) AS BIGINT) AS s, median(slope) AS slope FROM pairs GROUP BY 1),
tie AS (SELECT building_id, sum(t * (t - 1.0) * (2 * t + 5)) AS ties, CAST(sum(t) AS BIGINT) AS n FROM (SELECT building_id, x, count(*) AS t FROM ratios GROUP BY ALL) GROUP BY 1),
stat AS (SELECT t.building_id, t.n, s, slope, CASE WHEN s = 0 THEN 0.0 ELSE (s - sign(s)) / sqrt((n * (n - 1.0) * (2 * n + 5) - ties) / 18) END AS z FROM tie t JOIN ps USING (building_id))"""

ORACLES = {
    "building_calendar": f"WITH {CALENDAR} SELECT * FROM calendar",
    "weekend_backfill": f"""WITH {_CLOSE}, {_GRID} SELECT g.*, 'weekend' AS day_type, 'auto:weekday_check' AS source FROM bgrid g
        WHERE isodow(date) >= 6 AND NOT EXISTS (SELECT 1 FROM closures c WHERE c.building_id = g.building_id AND c.date = g.date)""",
    "calendar_upsert": f"""WITH {_CLOSE} SELECT tenant_id, building_id, date, CASE WHEN day(date) % 2 = 0 THEN 'holiday' ELSE 'declared_closure' END AS day_type,
        CASE WHEN day(date) % 2 = 0 THEN 'manual' ELSE source END AS source FROM closures
        UNION ALL SELECT tenant_id, building_id, CAST(date + 1 AS DATE), 'holiday', 'manual' FROM closures""",
    "day_types": f"WITH {DATED} SELECT circuit_id, ts, day_type FROM dated",
    "uncovered_circuits": f"""WITH {sql.READINGS}, g AS (SELECT circuit_id, count(*) AS n, bool_or(CAST(substr(building_id, 2) AS INT) % 3 = 1 AND day(ts) = 12) AS hole FROM readings GROUP BY 1)
        SELECT circuit_id, CASE WHEN hole THEN 0 ELSE n END AS n_rows, CASE WHEN hole THEN DATE '2024-01-12' END AS missing_date FROM g""",
    "rule_engine": f"""WITH {FIRES} SELECT tenant_id, building_id, circuit_id, ts, kwh, rule_id, CAST(version AS BIGINT) AS version,
        CASE rule_id WHEN 'weekend_vampire_load_v1' THEN 'low' ELSE 'medium' END AS severity FROM fires""",
    "rule_fire_maps": f"WITH {FIRES} SELECT circuit_id, ts, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM fires GROUP BY circuit_id, ts",
    "robust_residual_scores": f"""WITH {STAND_IN}, m AS (SELECT *, median(stl_residual) OVER w AS med FROM resid WINDOW w AS (PARTITION BY circuit_id, day_type)),
        d AS (SELECT *, abs(stl_residual - med) AS dv FROM m), s AS (SELECT *, median(dv) OVER w AS mad, avg(dv) OVER w AS mean FROM d WINDOW w AS (PARTITION BY circuit_id, day_type)),
        q AS (SELECT *, CASE WHEN mad = 0 THEN mean ELSE mad END AS sp FROM s),
        z AS (SELECT *, CASE WHEN sp = 0 THEN 0.0 ELSE (stl_residual - med) / greatest(1.4826 * sp, 1e-6) END AS z FROM q)
        SELECT circuit_id, ts, day_type, round(z, 6) + 0.0 AS residual_zscore, abs(z) > 3 AS is_anomalous FROM z""",
    "cohort_sizes": f"WITH {DATED} SELECT building_id, circuit_id, day_type, count(*) AS n_observations, count(*) < 48 AS low_data_quality FROM dated GROUP BY ALL",
    "residual_window_summary": f"""WITH {STAND_IN} SELECT tenant_id, building_id, circuit_id, min(ts) AS window_start, max(ts) AS window_end, count(*) AS n_readings,
        count(*) FILTER (residual_magnitude > 100) AS n_anomalous, count(*) FILTER (low_data_quality) AS n_low_quality FROM resid GROUP BY ALL""",
    "carried_series": f"""WITH {sql.GRID} SELECT circuit_id, ts, coalesce(last_value(obs IGNORE NULLS) OVER (PARTITION BY circuit_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(obs IGNORE NULLS) OVER (PARTITION BY circuit_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS kwh FROM dense""",
    "rolling_baseline": f"""WITH {ROLLED} SELECT circuit_id, ts, CASE WHEN kwh <> 0 THEN CASE WHEN hour(ts) BETWEEN 9 AND 20 THEN 1.0 ELSE 0.0 END END::DOUBLE AS peak_offpeak_split,
        (CASE WHEN hour(ts) >= 8 AND hour(ts) < 18 AND isodow(ts) < 6 THEN 0.0 ELSE 1.0 END)::DOUBLE AS after_hours_kwh_ratio, baseline AS rolling_baseline_kwh,
        round(CASE WHEN isodow(ts) >= 6 AND wd <> 0 THEN we / wd END, 6) AS weekend_floor_load, round(CASE WHEN baseline > 0 THEN kwh / baseline END, 6) AS rolling_efficiency_ratio FROM rolled""",
    "volume_baseline": "WITH v AS (SELECT CAST(l_suppkey AS VARCHAR) AS circuit_id, l_shipdate + l_linenumber * INTERVAL 1 HOUR AS ts, round(sum(l_quantity), 6) AS kwh FROM lineitem GROUP BY ALL), "
        + _ROLLING.format(src="v") + """ SELECT circuit_id, ts, kwh, baseline AS rolling_baseline_kwh, round(CASE WHEN isodow(ts) >= 6 AND wd <> 0 THEN we / wd END, 6) AS weekend_floor_load FROM rolled""",
    "feature_set": f"""WITH {FEATURES} SELECT circuit_id, ts, rolling_baseline_kwh, mag AS stl_residual_magnitude, day_type, low_data_quality, rules,
        'feature_set_v1' AS feature_schema_version FROM feats""",
    "feature_upsert": f"""WITH {FEATURES} SELECT tenant_id, circuit_id, ts, rolling_baseline_kwh,
        CASE WHEN circuit_id LIKE '%-click' OR circuit_id LIKE '%-view' THEN 'holiday' ELSE day_type END AS day_type, low_data_quality FROM feats""",
    "rule_layout": f"""WITH {FEATURES} SELECT DISTINCT f.tenant_id, f.building_id, array_to_string(ids, ',') AS rule_ids,
        'rolling_baseline_kwh,peak_offpeak_split,after_hours_kwh_ratio,weekend_floor_load,rolling_efficiency_ratio,stl_residual_magnitude,day_type_encoded,rule_fire_'||array_to_string(ids, ',rule_fire_') AS names
        FROM feats f JOIN lay USING (building_id)""",
    "feature_vectors": f"WITH {VECS} SELECT circuit_id, ts, pos, round(x, 9) AS x FROM longv",
    "scaler_parameters": f"""WITH {VECS} SELECT building_id, pos, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) < 1e-12 THEN 1.0 ELSE stddev_pop(x) END, 6) AS scale, count(*) AS n FROM longv GROUP BY ALL""",
    "chronological_split": f"""WITH {sql.READINGS}, p AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY ts, circuit_id) AS position, count(*) OVER (PARTITION BY building_id) AS n FROM readings)
        SELECT building_id, circuit_id, ts, position, CASE WHEN position <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN position <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM p""",
    "global_split": f"""WITH {sql.READINGS}, p AS (SELECT row_number() OVER (ORDER BY ts, circuit_id) AS position, count(*) OVER () AS n FROM readings),
        s AS (SELECT position, CASE WHEN position <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN position <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM p)
        SELECT split, count(*) AS n, max(position) AS "last" FROM s GROUP BY split""",
    "sliding_windows": f"""WITH {sql.READINGS}, w AS (SELECT circuit_id, ts, first_value(ts) OVER f AS window_start, count(*) OVER f AS n, sum(kwh + hour(ts)) OVER f AS total, first_value(kwh) OVER f AS oldest
        FROM readings WINDOW f AS (PARTITION BY circuit_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
        SELECT circuit_id, ts, window_start, CAST(48 AS BIGINT) AS length, round(total, 4) AS total, oldest FROM w WHERE n = 24""",
    "exact_percentile": f"WITH {sql.READINGS} SELECT building_id, round(quantile_cont(kwh, 0.95), 6) AS p95 FROM readings GROUP BY 1",
    "exact_percentile_volume": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1",
    "trend_statistics": f"WITH {TREND} SELECT building_id, n, s, round(z, 6) AS z, round(slope, 9) AS slope FROM stat",
    "rule_errors": f"""WITH {sql.READINGS}, u AS (SELECT *, hour(ts) AS h FROM readings WHERE data_quality_status <> 'quarantined')
        SELECT circuit_id, ts, 'zero_division_v1' AS rule_id FROM u WHERE h % 3 = 1 UNION ALL SELECT circuit_id, ts, 'bad_cast_v1' FROM u WHERE h % 2 = 0
        UNION ALL SELECT circuit_id, ts, 'far_element_v1' FROM u WHERE h % 4 = 1""",
    "drift_results": f"""WITH {TREND}, {sql.BUILDINGS}, t AS (SELECT s.*, b.tenant_id, CASE WHEN building_type = 'office' AND climate_zone = 'warm' THEN 0.6744897501960817 WHEN building_type = 'retail' THEN 2.5758293035489004 ELSE 1.959963984540054 END AS lim,
          CASE WHEN building_type = 'retail' THEN 5000 ELSE 10 END AS pts FROM stat s JOIN buildings b USING (building_id))
        SELECT tenant_id, building_id, n AS n_points, CASE WHEN n >= pts AND abs(z) > lim THEN 'drifting' ELSE 'stable' END AS status,
          CASE WHEN n >= pts AND abs(z) > lim THEN CASE WHEN z > 0 THEN 'increasing' ELSE 'decreasing' END ELSE 'none' END AS trend_direction,
          CASE WHEN n >= pts THEN round(slope, 9) END AS magnitude FROM t""",
}
_DRIFTING = f"SELECT * FROM ({ORACLES['drift_results']}) WHERE status = 'drifting'"
ORACLES["drift_retraining"] = f"""SELECT tenant_id, building_id, 'drift' AS trigger,
    'retraining-drift-'||tenant_id||'-'||building_id||'-2024-02-01T00:00:00+00:00' AS dedupe_key FROM ({_DRIFTING})"""
ORACLES["stale_baselines"] = f"SELECT building_id AS key, tenant_id, 'baseline_stale' AS notification_type FROM ({_DRIFTING})"
