"""Scenario, portfolio and report queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.operators import reporting, scenarios
from wattloom.session import cut_lineage
from wattloom.workbench import sql, views
from wattloom.workbench.views import plain

def _as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def _findings(spark, sf_dir):
    f = views.findings(spark, sf_dir)
    return f.withColumn("rule_ids", F.when(F.col("rule_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("rule_id")))


def _inputs(spark, sf_dir):
    r = scenarios.lookback(views.readings(spark, sf_dir), _as_of())
    return scenarios.Inputs(views.buildings(spark, sf_dir), views.circuits(spark, sf_dir), _findings(spark, sf_dir), r)


OUT = ["tenant_id", "building_id", "scenario_model", "outcome", "reason", "lead_finding_id", "n_justifying", *scenarios.MONEY, "payback_months"]


def load_shift(spark, sf_dir):
    return scenarios.load_shift(_inputs(spark, sf_dir)).select(*OUT)


def setpoint_adjustment(spark, sf_dir):
    return scenarios.setpoint_adjustment(_inputs(spark, sf_dir)).select(*OUT)


def solar_offset(spark, sf_dir):
    return scenarios.solar_offset(_inputs(spark, sf_dir)).select(*OUT)


def blended_tariff(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    t = scenarios.circuit_totals(i.readings).join(i.buildings, scenarios.KEYS)
    rate = scenarios.blended_rate(F.col("peak_kwh"), F.col("total_kwh"))
    return t.select("circuit_id", "n_rows", "total_kwh", "peak_kwh", F.round(rate, 6).alias("rate"))


def citing_findings(spark, sf_dir):
    f = scenarios.citing(scenarios.justifying(_findings(spark, sf_dir)))
    return f.groupBy("building_id").agg(F.count(F.lit(1)).alias("n"), F.min("finding_id").alias("smallest_id"))


def first_justifying(spark, sf_dir):
    return scenarios.first_finding(scenarios.justifying(_findings(spark, sf_dir)))


def _checked(spark, sf_dir):
    return scenarios.run_models(_inputs(spark, sf_dir))


def scenario_outcomes(spark, sf_dir):
    return scenarios.enforce_bounds(_checked(spark, sf_dir)).select(*OUT)


def scenario_incidents(spark, sf_dir):
    i = scenarios.incidents(_checked(spark, sf_dir), _as_of())
    return plain(i.select("tenant_id", "building_id", "scenario_model", "incident_type", "severity", "message", "metadata", "created_at"))


def scenario_bounds(spark, sf_dir):
    """Every bound broken somewhere: figures taken from orders."""
    o = views.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = F.round(F.col("o_totalprice"), 2)
    opt = F.round(base * ((k % 13) / 10.0), 2)
    rows = o.select(
        F.col("o_orderkey").alias("key"), F.lit("scenario").alias("outcome"), base.alias("baseline_kwh"), opt.alias("optimized_kwh"),
        base.alias("baseline_emissions_kg_co2"), F.round(base * ((k % 11) / 10.0), 2).alias("optimized_emissions_kg_co2"),
        ((k % 90) - 5.5).alias("pct_reduction"), (F.col("o_custkey") % 200 * 1.0).alias("payback_months"),
    )
    c = scenarios.bounds_check(rows)
    return c.select("key", F.array_join(F.transform("violations", lambda v: v["incident_type"]), ",").alias("kinds"),
                    F.size("violations").cast("long").alias("n"))


def portfolio_rollup(spark, sf_dir):
    return scenarios.portfolio(scenarios.enforce_bounds(_checked(spark, sf_dir)))[0].select(
        "scenario_model", "n_contributing", "total_baseline_kwh", "total_optimized_kwh", "total_baseline_emissions_kg_co2",
        "total_optimized_emissions_kg_co2", "pct_reduction", "total_estimated_annual_savings_inr",
    )


def portfolio_members(spark, sf_dir):
    members = views.buildings(spark, sf_dir).select(*scenarios.KEYS, F.substring("building_id", 2, 9).cast("int").alias("ordinal")).filter("ordinal <> 1")
    return scenarios.portfolio(scenarios.enforce_bounds(_checked(spark, sf_dir)), members)[1].select("scenario_model", "building_id", F.col("ordinal").cast("long").alias("ordinal"))


def _tenants(spark, sf_dir):
    n = views.table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 2).alias("n")).distinct()
    return n.select(F.concat(F.lit("t"), F.col("n").cast("string")).alias("tenant_id"), (F.col("n") % 3 != 2).alias("cross_tenant_aggregate_opt_in"))


def _peaked(spark, sf_dir):
    return views.readings(spark, sf_dir).withColumn("is_peak_hour", F.hour("ts").between(9, 18))


def off_peak_share(spark, sf_dir):
    s = scenarios.off_peak_share(_peaked(spark, sf_dir), ["tenant_id"])
    return s.select("tenant_id", F.round("ratio", 6).alias("ratio"))


def opt_in_prior(spark, sf_dir):
    p = scenarios.opt_in_prior(_tenants(spark, sf_dir), _peaked(spark, sf_dir), views.buildings(spark, sf_dir), "office", "warm")
    return p.select(F.round("prior", 6).alias("prior"), "n_tenants")


def consent_audit(spark, sf_dir):
    return scenarios.consent_audit(_tenants(spark, sf_dir)).drop("entity_id")


def bundled(spark, sf_dir):
    """Findings with bundles made of their own columns."""
    f = _findings(spark, sf_dir)
    ml = F.col("layer_origin") == "ml_ensemble"
    top = F.when(ml, F.array(F.struct(F.lit("after_hours_kwh_ratio").alias("feature"), F.round(F.col("anomaly_score") / 10, 4).alias("shap_value"),
                                      F.concat(F.lit("score was "), F.col("anomaly_score").cast("string")).alias("plain_language"))))
    cites = F.transform("rule_ids", lambda r: F.struct(r.alias("rule_id"), F.lit(1).alias("version"), F.concat(F.lit("guide "), r).alias("citation")))
    band = F.when(F.col("confidence").isNotNull(), F.struct(F.round(F.col("confidence") * 0.75, 10).alias("lower"), F.col("confidence").alias("upper"), F.lit("conformal_prediction").alias("method")))
    bundle = F.struct(
        F.col("finding_id"), F.array("layer_origin").alias("contributing_layers"),
        F.coalesce(top, F.array().cast("array<struct<feature:string,shap_value:double,plain_language:string>>")).alias("top_features"),
        cites.alias("rule_citations"), band.alias("confidence_band"), F.struct(F.col("detected_at").alias("start"), F.col("detected_at").alias("end")).alias("evidence_window"),
    )
    return f.withColumn("bundle", bundle)


def _report(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    # one row per building and model, used several times below: kept as a table
    sc = cut_lineage(scenarios.enforce_bounds(scenarios.run_models(inp)))
    return bundled(spark, sf_dir), sc, scenarios.justifications(sc, inp.findings), inp.buildings


def report_leads(spark, sf_dir):
    lead = reporting.lead_findings(reporting.report_findings(bundled(spark, sf_dir)))
    return lead.select("building_id", F.col("lead.finding_id").alias("finding_id"), F.col("lead.lower").alias("lower"), F.col("lead.upper").alias("upper"), "n_findings")


def report_narratives(spark, sf_dir):
    f, _, _, b = _report(spark, sf_dir)
    return reporting.narratives(reporting.lead_findings(reporting.report_findings(f)), b).select("building_id", "narrative_summary")


def action_plan_items(spark, sf_dir):
    f, sc, j, b = _report(spark, sf_dir)
    p = reporting.action_plans(f, sc, j, b).select("building_id", "generated_by", F.explode("actions").alias("a"))
    return p.select("building_id", "generated_by", "a.*").withColumn("estimated_co2_saved_kg_per_year", F.round("estimated_co2_saved_kg_per_year", 4))


def report_payloads(spark, sf_dir):
    f, sc, _, b = _report(spark, sf_dir)
    p = F.col("payload")
    doc = reporting.report_payloads(f, sc, b)
    return doc.select("building_id", F.get_json_object(p, "$.building").alias("name"), F.get_json_object(p, "$.findings[0].finding_id").alias("newest"),
                      F.get_json_object(p, "$.findings[0].evidence_window.start").alias("since"), F.json_array_length(F.get_json_object(p, "$.findings")).cast("long").alias("n_findings"),
                      F.json_array_length(F.get_json_object(p, "$.optimization_scenarios")).cast("long").alias("n_scenarios"))


def scenario_justifications(spark, sf_dir):
    _, _, j, _ = _report(spark, sf_dir)
    return j.groupBy("building_id", "scenario_model").agg(F.count(F.lit(1)).alias("n"), F.min("finding_id").alias("smallest_id"))


QUERIES = {
    f.__name__: f
    for f in (
        load_shift, setpoint_adjustment, solar_offset, blended_tariff, citing_findings, first_justifying, scenario_outcomes,
        scenario_incidents, scenario_bounds, portfolio_rollup, portfolio_members, off_peak_share, opt_in_prior, consent_audit,
        report_leads, report_narratives, action_plan_items, report_payloads, scenario_justifications,
    )
}

R2 = "round_even(({x}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE"


def _r2(x: str) -> str:
    return R2.format(x=x)


_BASE = f"""{sql.READINGS}, {sql.CIRCUITS}, {sql.BUILDINGS}, {sql.FINDINGS},
win AS (SELECT * FROM readings WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' AND data_quality_status <> 'quarantined'),
tot AS (SELECT tenant_id, building_id, circuit_id, count(*) AS n_rows, round(sum(kwh), 6) AS total_kwh,
          coalesce(round(sum(CASE WHEN hour(ts) BETWEEN 9 AND 18 THEN kwh END), 6), 0) AS peak_kwh FROM win GROUP BY ALL),
live AS (SELECT * FROM findings WHERE status <> 'dismissed'),
b AS (SELECT *, coalesce(peak_rate, 9.5::DOUBLE) AS pr, coalesce(offpeak_rate, 6.0::DOUBLE) AS orr FROM buildings),
lead_ls AS (SELECT * FROM live WHERE rule_id IN ('hvac_after_hours_v3','weekend_vampire_load_v1','scheduling_violation_v1')
            QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY detected_at, finding_id) = 1),
lead_sp AS (SELECT f.* FROM live f WHERE EXISTS (SELECT 1 FROM circuits c WHERE c.circuit_id = f.circuit_id AND c.circuit_type = 'hvac')
            QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY detected_at, finding_id) = 1),
lead_so AS (SELECT building_id, count(*) AS n, arg_min(finding_id, (detected_at, finding_id)) AS finding_id FROM live GROUP BY 1),
ls0 AS (SELECT b.*, f.finding_id, f.circuit_id, t.n_rows, t.peak_kwh, t.total_kwh, CASE WHEN orr < pr THEN peak_kwh * 0.4::DOUBLE ELSE 0.0 END AS moved,
          CASE WHEN f.finding_id IS NULL THEN 'No open/confirmed finding cites a load-timing rule ([''hvac_after_hours_v3'', ''scheduling_violation_v1'', ''weekend_vampire_load_v1'']) for this building.'
               WHEN t.n_rows IS NULL THEN 'Justifying finding '||f.finding_id||' cites circuit '||f.circuit_id||', but no normalized_readings were found for it in the lookback window.'
               WHEN t.peak_kwh <= 0 THEN 'No peak-hour consumption found for the justifying circuit.' END AS reason
        FROM b LEFT JOIN lead_ls f ON f.building_id = b.building_id AND f.tenant_id = b.tenant_id LEFT JOIN tot t ON t.building_id = b.building_id AND t.circuit_id = f.circuit_id),
ls1 AS (SELECT *, 'load_shift_v1' AS scenario_model, 1 AS n, peak_kwh AS bk, peak_kwh - moved AS ok, moved / peak_kwh * 100.0 AS pct, 0.7::DOUBLE AS lo, 1.3::DOUBLE AS hi, 0.0::DOUBLE AS pay,
          greatest(peak_kwh * pr - ((peak_kwh - moved) * pr + moved * orr), 0.0) * (365.0::DOUBLE / 30) AS sav FROM ls0),
sp0 AS (SELECT b.*, f.finding_id, f.circuit_id, t.n_rows, t.peak_kwh, t.total_kwh,
          CASE WHEN f.finding_id IS NULL THEN 'No open/confirmed finding cites an HVAC circuit for this building.'
               WHEN t.n_rows IS NULL THEN 'Justifying finding '||f.finding_id||' cites HVAC circuit '||f.circuit_id||', but no normalized_readings were found for it in the lookback window.'
               WHEN t.total_kwh <= 0 THEN 'No positive HVAC consumption found in the lookback window.' END AS reason
        FROM b LEFT JOIN lead_sp f ON f.building_id = b.building_id AND f.tenant_id = b.tenant_id LEFT JOIN tot t ON t.building_id = b.building_id AND t.circuit_id = f.circuit_id),
sp1 AS (SELECT *, 'setpoint_adjustment_v1' AS scenario_model, 1 AS n, total_kwh AS bk, total_kwh * 0.94::DOUBLE AS ok, 6.0::DOUBLE AS pct, 0.6::DOUBLE AS lo, 1.4::DOUBLE AS hi, 0.0::DOUBLE AS pay,
          (total_kwh - total_kwh * 0.94::DOUBLE) * (peak_kwh / total_kwh * pr + (1.0 - peak_kwh / total_kwh) * orr) * (365.0::DOUBLE / 30) AS sav FROM sp0),
bt AS (SELECT tenant_id, building_id, round(sum(total_kwh), 6) AS total_kwh, round(sum(peak_kwh), 6) AS peak_kwh FROM tot GROUP BY ALL),
so0 AS (SELECT b.*, f.finding_id, f.n, coalesce(t.total_kwh, 0) AS total_kwh, coalesce(t.peak_kwh, 0) AS peak_kwh,
          CASE WHEN abs(latitude) <= 15 THEN 5.6::DOUBLE WHEN abs(latitude) <= 23 THEN 5.2 WHEN abs(latitude) <= 30 THEN 4.8 WHEN abs(latitude) <= 90 THEN 4.2 END AS sun
        FROM b LEFT JOIN lead_so f ON f.building_id = b.building_id LEFT JOIN bt t ON t.building_id = b.building_id AND t.tenant_id = b.tenant_id),
so1 AS (SELECT *, total_kwh * (365.0::DOUBLE / 30) AS bk, greatest(total_kwh * (365.0::DOUBLE / 30) - rooftop_area_sqm * sun * 0.18::DOUBLE * 0.75::DOUBLE * 365.0::DOUBLE, 0.0) AS ok,
          CASE WHEN n IS NULL THEN 'No open/confirmed finding exists for this building.' WHEN rooftop_area_sqm IS NULL OR rooftop_area_sqm <= 0 THEN 'Building has no declared usable rooftop area.'
               WHEN latitude IS NULL OR longitude IS NULL THEN 'Building has no declared location (latitude/longitude).' WHEN sun IS NULL THEN 'SolarProvider has no irradiance data for this building''s location.'
               WHEN total_kwh <= 0 THEN 'No positive building-wide consumption found in the lookback window.' END AS reason FROM so0),
so2 AS (SELECT *, 'solar_offset_v1' AS scenario_model, (bk - ok) / bk * 100.0 AS pct, 0.75::DOUBLE AS lo, 1.25::DOUBLE AS hi,
          (bk - ok) * CASE WHEN total_kwh > 0 THEN peak_kwh / total_kwh * pr + (1.0 - peak_kwh / total_kwh) * orr ELSE orr END AS sav FROM so1),
so3 AS (SELECT *, CASE WHEN sav > 0 THEN rooftop_area_sqm * 0.15::DOUBLE * 45000.0::DOUBLE / (sav / 12.0) ELSE 9999.0 END AS pay FROM so2)"""

_COLS = f"""tenant_id, building_id, scenario_model, CASE WHEN reason IS NULL THEN 'scenario' ELSE 'unavailable' END AS outcome, reason,
  CASE WHEN reason IS NULL THEN finding_id END AS lead_finding_id, CASE WHEN reason IS NULL THEN CAST(n AS BIGINT) END AS n_justifying,
  CASE WHEN reason IS NULL THEN {_r2('bk')} END AS baseline_kwh, CASE WHEN reason IS NULL THEN {_r2('ok')} END AS optimized_kwh,
  CASE WHEN reason IS NULL THEN {_r2('bk * 0.71::DOUBLE')} END AS baseline_emissions_kg_co2, CASE WHEN reason IS NULL THEN {_r2('ok * 0.71::DOUBLE')} END AS optimized_emissions_kg_co2,
  CASE WHEN reason IS NULL THEN {_r2('pct')} END AS pct_reduction, CASE WHEN reason IS NULL THEN {_r2('pct * lo')} END AS band_lower_pct,
  CASE WHEN reason IS NULL THEN {_r2('least(pct * hi, 100.0)')} END AS band_upper_pct, CASE WHEN reason IS NULL THEN {_r2('sav')} END AS estimated_annual_savings_inr,
  CASE WHEN reason IS NULL THEN round_even(pay * 10.0::DOUBLE, 0) / 10.0::DOUBLE END AS payback_months"""

_ALL = f"""{_BASE}, sc AS (SELECT {_COLS} FROM ls1 UNION ALL SELECT {_COLS} FROM sp1 UNION ALL SELECT {_COLS} FROM so3),
ck AS (SELECT *, (baseline_kwh - optimized_kwh) / baseline_kwh * 100.0 AS implied FROM sc),
vio AS (SELECT *, concat_ws('; ',
    CASE WHEN optimized_kwh > baseline_kwh THEN 'a' END,
    CASE WHEN NOT (pct_reduction BETWEEN 0 AND 60) THEN printf('pct_reduction (%.2f) is outside the physically plausible range [0.0, 60.0].', pct_reduction) END,
    CASE WHEN payback_months > 120 THEN printf('payback_months (%.1f) exceeds the plausible ceiling (120.0).', payback_months) END) AS msg,
    concat_ws('","', CASE WHEN NOT (pct_reduction BETWEEN 0 AND 60) THEN 'pct_reduction_out_of_range' END, CASE WHEN payback_months > 120 THEN 'payback_implausible' END) AS kinds FROM ck),
fin AS (SELECT tenant_id, building_id, scenario_model, CASE WHEN msg <> '' THEN 'unavailable' ELSE outcome END AS outcome,
    CASE WHEN msg <> '' THEN 'Rejected at the service layer (bounds check failed): '||msg ELSE reason END AS reason,
    CASE WHEN msg = '' THEN lead_finding_id END AS lead_finding_id, CASE WHEN msg = '' THEN n_justifying END AS n_justifying,
    CASE WHEN msg = '' THEN baseline_kwh END AS baseline_kwh, CASE WHEN msg = '' THEN optimized_kwh END AS optimized_kwh,
    CASE WHEN msg = '' THEN baseline_emissions_kg_co2 END AS baseline_emissions_kg_co2, CASE WHEN msg = '' THEN optimized_emissions_kg_co2 END AS optimized_emissions_kg_co2,
    CASE WHEN msg = '' THEN pct_reduction END AS pct_reduction, CASE WHEN msg = '' THEN band_lower_pct END AS band_lower_pct, CASE WHEN msg = '' THEN band_upper_pct END AS band_upper_pct,
    CASE WHEN msg = '' THEN estimated_annual_savings_inr END AS estimated_annual_savings_inr, CASE WHEN msg = '' THEN payback_months END AS payback_months FROM vio)"""

_REPORT = f"""{_ALL},
rep AS (SELECT *, coalesce(confidence, 0) AS conf, CASE WHEN confidence IS NULL THEN 0.0 ELSE round(confidence * 0.75::DOUBLE, 10) END AS lower, coalesce(confidence, 1.0) AS upper,
          row_number() OVER (PARTITION BY building_id ORDER BY detected_at DESC, finding_id) AS rank FROM findings WHERE status = 'open' QUALIFY rank <= 200),
lead AS (SELECT *, count(*) OVER (PARTITION BY building_id) AS n_findings FROM rep QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY conf DESC, rank) = 1),
told AS (SELECT l.*, b.name FROM lead l JOIN buildings b USING (tenant_id, building_id)),
just AS (SELECT building_id, scenario_model, lead_finding_id AS finding_id FROM fin WHERE outcome = 'scenario' AND scenario_model <> 'solar_offset_v1'
         UNION ALL SELECT l.building_id, 'solar_offset_v1', l.finding_id FROM live l WHERE l.building_id IN (SELECT building_id FROM fin WHERE outcome = 'scenario' AND scenario_model = 'solar_offset_v1')),
note AS (SELECT r.building_id, j.scenario_model, arg_min(r.lower, rank) AS nl, arg_min(r.upper, rank) AS nu FROM rep r JOIN just j ON j.building_id = r.building_id AND j.finding_id = r.finding_id GROUP BY ALL)"""


def _pc(x: str) -> str:
    return f"CAST(round_even({x} * 100.0::DOUBLE, 0) AS BIGINT)||'%'"


def _note(lo: str, hi: str) -> str:
    band = f"{_pc(lo)}||'–'||{_pc(hi)}"
    return f"""CASE WHEN {hi} - {lo} <= 0.10 THEN 'High confidence (confidence band '||{band}||'): multiple detection layers corroborate this finding.'
      WHEN {hi} - {lo} <= 0.25 THEN 'Moderate confidence (confidence band '||{band}||'): this finding is supported but has some uncertainty.'
      ELSE 'Lower confidence (confidence band '||{band}||'): this is a statistical pattern only — the evidence has higher uncertainty than a rule-confirmed finding.' END"""


ORACLES = {
    "load_shift": f"WITH {_BASE} SELECT {_COLS} FROM ls1",
    "setpoint_adjustment": f"WITH {_BASE} SELECT {_COLS} FROM sp1",
    "solar_offset": f"WITH {_BASE} SELECT {_COLS} FROM so3",
    "blended_tariff": f"""WITH {_BASE} SELECT t.circuit_id, n_rows, t.total_kwh, t.peak_kwh,
        round(CASE WHEN t.total_kwh > 0 THEN t.peak_kwh / t.total_kwh * pr + (1.0 - t.peak_kwh / t.total_kwh) * orr ELSE orr END, 6) AS rate FROM tot t JOIN b USING (tenant_id, building_id)""",
    "citing_findings": f"""WITH {sql.FINDINGS} SELECT building_id, count(*) AS n, min(finding_id) AS smallest_id FROM findings
        WHERE status <> 'dismissed' AND rule_id IN ('hvac_after_hours_v3','weekend_vampire_load_v1','scheduling_violation_v1') GROUP BY 1""",
    "first_justifying": f"""WITH {sql.FINDINGS} SELECT tenant_id, building_id, finding_id, circuit_id FROM findings WHERE status <> 'dismissed'
        QUALIFY row_number() OVER (PARTITION BY tenant_id, building_id ORDER BY detected_at, finding_id) = 1""",
    "scenario_outcomes": f"WITH {_ALL} SELECT * FROM fin",
    "scenario_incidents": f"""WITH {_ALL} SELECT tenant_id, building_id, scenario_model, string_split(kinds, '","')[1] AS incident_type, 'warning' AS severity, msg AS message,
        '{{"violation_types":["'||kinds||'"]}}' AS metadata, TIMESTAMP '2024-01-31' AS created_at FROM vio WHERE msg <> ''""",
    "scenario_bounds": """WITH r AS (SELECT o_orderkey AS key, round(o_totalprice, 2) AS bk, round(round(o_totalprice, 2) * ((o_orderkey % 13) / 10.0::DOUBLE), 2) AS ok, round(round(o_totalprice, 2) * ((o_orderkey % 11) / 10.0::DOUBLE), 2) AS oe,
          ((o_orderkey % 90) - 5.5)::DOUBLE AS pct, (o_custkey % 200)::DOUBLE AS pay FROM orders),
        v AS (SELECT key, list_filter([CASE WHEN ok > bk THEN 'consumption_increase' END, CASE WHEN oe > bk THEN 'emissions_increase' END,
          CASE WHEN bk > 0 AND abs((bk - ok) / bk * 100.0 - pct) > 1.0 THEN 'pct_reduction_inconsistent' END, CASE WHEN NOT (pct BETWEEN 0 AND 60) THEN 'pct_reduction_out_of_range' END,
          CASE WHEN pay > 120 THEN 'payback_implausible' END], lambda x: x IS NOT NULL) AS k FROM r)
        SELECT key, coalesce(array_to_string(k, ','), '') AS kinds, len(k) AS n FROM v""",
    "portfolio_rollup": f"""WITH {_ALL}, s AS (SELECT scenario_model, count(*) AS n_contributing, round(sum(baseline_kwh), 6) AS a, round(sum(optimized_kwh), 6) AS o, round(sum(baseline_emissions_kg_co2), 6) AS ea,
          round(sum(optimized_emissions_kg_co2), 6) AS eo, round(sum(estimated_annual_savings_inr), 6) AS sv FROM fin WHERE outcome = 'scenario' GROUP BY 1)
        SELECT scenario_model, n_contributing, {_r2('a')} AS total_baseline_kwh, {_r2('o')} AS total_optimized_kwh, {_r2('ea')} AS total_baseline_emissions_kg_co2, {_r2('eo')} AS total_optimized_emissions_kg_co2,
          {_r2('CASE WHEN a > 0 THEN (a - o) / a * 100.0 ELSE 0.0 END')} AS pct_reduction, {_r2('sv')} AS total_estimated_annual_savings_inr FROM s""",
    "portfolio_members": f"""WITH {_ALL} SELECT scenario_model, building_id, CAST(substr(building_id, 2) AS BIGINT) AS ordinal FROM fin WHERE outcome = 'scenario' AND building_id <> 'b1'""",
    "off_peak_share": f"""WITH {sql.READINGS} SELECT tenant_id, round(round(sum(CASE WHEN NOT hour(ts) BETWEEN 9 AND 18 THEN kwh ELSE 0 END), 6) / nullif(round(sum(kwh), 6), 0), 6) AS ratio FROM readings GROUP BY 1""",
    "opt_in_prior": f"""WITH {sql.READINGS}, {sql.BUILDINGS}, s AS (SELECT r.tenant_id, round(sum(CASE WHEN NOT hour(ts) BETWEEN 9 AND 18 THEN kwh ELSE 0 END), 6) / nullif(round(sum(kwh), 6), 0) AS ratio
          FROM readings r JOIN buildings b ON b.building_id = r.building_id WHERE b.building_type = 'office' AND b.climate_zone = 'warm' AND CAST(substr(r.tenant_id, 2) AS INT) % 3 <> 2 GROUP BY 1)
        SELECT round(median(ratio), 6) AS prior, count(ratio) AS n_tenants FROM s""",
    "consent_audit": """SELECT 't'||n AS tenant_id, 'cross_tenant_consent_check' AS event_type,
        '{"opt_in_consent":'||CASE WHEN n % 3 <> 2 THEN 'true' ELSE 'false' END||',"pipeline":"cold_start_prior_aggregation"}' AS payload FROM (SELECT DISTINCT s_suppkey//2 AS n FROM supplier)""",
    "report_leads": f"WITH {_REPORT} SELECT building_id, finding_id, lower, upper, n_findings FROM lead",
    "report_narratives": f"""WITH {_REPORT} SELECT building_id, CASE WHEN layer_origin = 'ml_ensemble' THEN 'A statistical pattern was detected:' WHEN rule_id IS NOT NULL THEN 'A domain rule was triggered (guide '||rule_id||'):' ELSE 'An anomaly was detected:' END
        ||' '||CASE WHEN layer_origin = 'ml_ensemble' THEN 'score was '||anomaly_score ELSE 'an unusual consumption pattern was detected' END||'. Confidence band: '||{_pc('lower')}||'–'||{_pc('upper')}
        ||' (method: conformal_prediction). '||n_findings||' finding(s) analysed for '||name||'.' AS narrative_summary FROM told""",
    "action_plan_items": f"""WITH {_REPORT}, acts AS (
        SELECT t.building_id, 'fallback' AS generated_by, 'Optimise: '||CASE f.scenario_model WHEN 'load_shift_v1' THEN 'Load Shift' WHEN 'solar_offset_v1' THEN 'Solar Offset' ELSE 'Setpoint Adjustment' END AS title,
          printf('Shift %s to reduce consumption from %.0f kWh to %.0f kWh (%.1f%% reduction).', replace(f.scenario_model, '_', ' '), round_even(baseline_kwh, 0), round_even(optimized_kwh, 0), round_even(pct_reduction * 10.0::DOUBLE, 0) / 10.0::DOUBLE) AS description,
          f.lead_finding_id AS justifying_finding_id, round(greatest(0.0, baseline_emissions_kg_co2 - optimized_emissions_kg_co2), 4) AS estimated_co2_saved_kg_per_year, estimated_annual_savings_inr AS estimated_savings_inr_per_year,
          CASE WHEN payback_months <= 6 THEN 'Low' WHEN payback_months <= 24 THEN 'Medium' ELSE 'High' END AS effort_level, payback_months,
          {_note('coalesce(n.nl, t.lower)', 'coalesce(n.nu, t.upper)')} AS confidence_note
        FROM fin f JOIN told t USING (tenant_id, building_id) LEFT JOIN note n ON n.building_id = f.building_id AND n.scenario_model = f.scenario_model WHERE f.outcome = 'scenario')
        SELECT * FROM acts UNION ALL
        SELECT building_id, 'fallback', 'Investigate anomalous consumption pattern', 'Review after hours kwh ratio for '||name||'. Schedule site inspection.', finding_id, 0.0, 0.0, 'Low', 0.0, {_note('lower', 'upper')}
        FROM told t WHERE layer_origin = 'ml_ensemble' AND NOT EXISTS (SELECT 1 FROM acts a WHERE a.building_id = t.building_id)""",
    "report_payloads": f"""WITH {_REPORT} SELECT r.building_id, any_value(b.name) AS name, arg_min(finding_id, rank) AS newest, strftime(arg_min(detected_at, rank), '%Y-%m-%dT%H:%M:%S+00:00') AS since, count(*) AS n_findings,
        (SELECT count(*) FROM fin WHERE fin.building_id = r.building_id AND outcome = 'scenario') AS n_scenarios FROM rep r JOIN buildings b USING (tenant_id, building_id) GROUP BY r.building_id""",
    "scenario_justifications": f"WITH {_REPORT} SELECT building_id, scenario_model, count(*) AS n, min(finding_id) AS smallest_id FROM just GROUP BY ALL",
}
