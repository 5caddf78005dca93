"""Savings scenarios for all buildings at once.

Readings are summed per circuit first; from there on every table has one row per building, so the
scenario models are plain expressions over a few narrow joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.config import IRRADIANCE_BANDS, LOAD_TIMING_RULES, ScenarioConfig
from wattloom.functions.scalars import annual_factor, fixed_text, half_even, stable_id, stable_sum
from wattloom.operators.skew import salted_join

KEYS = ["tenant_id", "building_id"]
MONEY = ("baseline_kwh", "optimized_kwh", "baseline_emissions_kg_co2", "optimized_emissions_kg_co2",
         "pct_reduction", "band_lower_pct", "band_upper_pct", "estimated_annual_savings_inr")


@dataclass
class Inputs:
    buildings: DataFrame  # keys, peak_rate, offpeak_rate, rooftop_area_sqm, latitude, longitude
    circuits: DataFrame  # keys, circuit_id, circuit_type
    findings: DataFrame  # keys, finding_id, circuit_id, status, rule_ids, detected_at
    readings: DataFrame  # keys, circuit_id, ts, kwh: usable rows of the lookback window


# --- context ---------------------------------------------------------------------------------
def is_peak(cfg: ScenarioConfig) -> Column:
    return F.hour("ts").between(cfg.peak_first, cfg.peak_last)


def circuit_totals(readings: DataFrame, cfg: ScenarioConfig = ScenarioConfig()) -> DataFrame:
    """Rows, total and peak-hour kWh per circuit."""
    return readings.groupBy(*KEYS, "circuit_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(stable_sum("kwh"), F.lit(0.0)).alias("total_kwh"),
        F.coalesce(stable_sum(F.when(is_peak(cfg), F.col("kwh"))), F.lit(0.0)).alias("peak_kwh"),
    )


def rates(cfg: ScenarioConfig = ScenarioConfig()) -> tuple[Column, Column]:
    """Declared peak and off-peak rate, each with its default."""
    return F.coalesce("peak_rate", F.lit(cfg.peak_rate)), F.coalesce("offpeak_rate", F.lit(cfg.offpeak_rate))


def blended_rate(peak_kwh: Column, total_kwh: Column, cfg: ScenarioConfig = ScenarioConfig()) -> Column:
    peak, off = rates(cfg)
    share = peak_kwh / total_kwh
    return F.when(total_kwh > 0, share * peak + (F.lit(1.0) - share) * off).otherwise(off)


def irradiance(latitude: str = "latitude", longitude: str = "longitude") -> Column:
    """Daily irradiance by latitude band; nothing outside the globe."""
    lat = F.abs(F.col(latitude))
    out = F.lit(None).cast("double")
    for edge, value in reversed(IRRADIANCE_BANDS):
        out = F.when(lat <= edge, F.lit(value)).otherwise(out)
    ok = F.col(latitude).between(-90, 90) & F.col(longitude).between(-180, 180)
    return F.when(ok, out)


def carbon_intensity(cfg: ScenarioConfig) -> Column:
    return F.lit(cfg.carbon)


def justifying(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("status") != "dismissed")


def citing(findings: DataFrame, rule_ids=LOAD_TIMING_RULES) -> DataFrame:
    """Findings that cite any of the rules."""
    return findings.filter(F.arrays_overlap("rule_ids", F.array(*[F.lit(r) for r in rule_ids])))


def first_finding(findings: DataFrame) -> DataFrame:
    """Earliest finding per building, ties by id."""
    order = F.struct("detected_at", "finding_id")
    return findings.groupBy(*KEYS).agg(F.min_by(F.struct("finding_id", "circuit_id"), order).alias("_f")).select(
        *KEYS, F.col("_f.finding_id").alias("finding_id"), F.col("_f.circuit_id").alias("circuit_id")
    )


# --- one row per building and model ------------------------------------------------------------
def _outcome(df: DataFrame, model: str, reason: Column, values: dict[str, Column], n: Column) -> DataFrame:
    ok = reason.isNull()
    return df.select(
        *KEYS,
        F.lit(model).alias("scenario_model"),
        F.lit(1).alias("model_version"),
        F.when(ok, "scenario").otherwise("unavailable").alias("outcome"),
        reason.alias("reason"),
        F.when(ok, F.col("finding_id")).alias("lead_finding_id"),
        F.when(ok, n).cast("long").alias("n_justifying"),
        *[F.when(ok, half_even(values[c], 2)).alias(c) for c in MONEY],
        F.when(ok, half_even(values["payback_months"], 1)).alias("payback_months"),
    )


def _figures(base: Column, optimized: Column, pct: Column, savings: Column, low: float, high: float, payback: Column, cfg) -> dict:
    carbon = carbon_intensity(cfg)
    return {
        "baseline_kwh": base,
        "optimized_kwh": optimized,
        "baseline_emissions_kg_co2": base * carbon,
        "optimized_emissions_kg_co2": optimized * carbon,
        "pct_reduction": pct,
        "band_lower_pct": pct * low,
        "band_upper_pct": F.least(pct * high, F.lit(100.0)),
        "estimated_annual_savings_inr": savings,
        "payback_months": payback,
    }


def load_shift(inp: Inputs, cfg: ScenarioConfig = ScenarioConfig()) -> DataFrame:
    """Peak load moved to cheaper hours. One bounded variable with a linear cost: the optimum is the
    upper bound when off-peak is cheaper, else nothing moves."""
    lead = first_finding(citing(justifying(inp.findings)))
    df = inp.buildings.join(lead, KEYS, "left").join(circuit_totals(inp.readings, cfg), [*KEYS, "circuit_id"], "left")
    peak_rate, off_rate = rates(cfg)
    peak = F.col("peak_kwh")
    moved = F.when(off_rate < peak_rate, peak * cfg.shiftable).otherwise(0.0)
    rest = peak - moved
    saved = F.greatest(peak * peak_rate - (rest * peak_rate + moved * off_rate), F.lit(0.0)) * annual_factor(cfg.window_days)
    rules = "[" + ", ".join(f"'{r}'" for r in sorted(LOAD_TIMING_RULES)) + "]"
    reason = (
        F.when(F.col("finding_id").isNull(), f"No open/confirmed finding cites a load-timing rule ({rules}) for this building.")
        .when(F.col("n_rows").isNull(), _no_readings("circuit"))
        .when(peak <= 0, "No peak-hour consumption found for the justifying circuit.")
    )
    figures = _figures(peak, rest, moved / peak * 100.0, saved, 0.7, 1.3, F.lit(0.0), cfg)
    return _outcome(df, "load_shift_v1", reason, figures, F.lit(1))


def setpoint_adjustment(inp: Inputs, cfg: ScenarioConfig = ScenarioConfig()) -> DataFrame:
    """Setpoint relaxed by the largest allowed step on the circuit of the first HVAC finding."""
    hvac = inp.circuits.filter("circuit_type = 'hvac'").select(*KEYS, "circuit_id").distinct()
    lead = first_finding(salted_join(justifying(inp.findings), hvac, [*KEYS, "circuit_id"], "left_semi"))
    df = inp.buildings.join(lead, KEYS, "left").join(circuit_totals(inp.readings, cfg), [*KEYS, "circuit_id"], "left")
    total = F.col("total_kwh")
    share = min(cfg.per_degree * cfg.max_delta_c, 1.0)
    rest = total * (1.0 - share)
    saved = (total - rest) * blended_rate(F.col("peak_kwh"), total, cfg) * annual_factor(cfg.window_days)
    reason = (
        F.when(F.col("finding_id").isNull(), "No open/confirmed finding cites an HVAC circuit for this building.")
        .when(F.col("n_rows").isNull(), _no_readings("HVAC circuit"))
        .when(total <= 0, "No positive HVAC consumption found in the lookback window.")
    )
    figures = _figures(total, rest, F.lit(share * 100.0), saved, 0.6, 1.4, F.lit(0.0), cfg)
    return _outcome(df, "setpoint_adjustment_v1", reason, figures, F.lit(1))


def solar_offset(inp: Inputs, cfg: ScenarioConfig = ScenarioConfig()) -> DataFrame:
    """Rooftop generation set against the whole building's use. All live findings justify it: they
    are counted here and listed by `justifications`."""
    live = justifying(inp.findings)
    counts = live.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("finding_id", F.struct("detected_at", "finding_id")).alias("finding_id")
    )
    sums = circuit_totals(inp.readings, cfg).groupBy(*KEYS).agg(
        stable_sum("total_kwh").alias("total_kwh"), stable_sum("peak_kwh").alias("peak_kwh")
    )
    df = inp.buildings.join(counts, KEYS, "left").join(sums, KEYS, "left").withColumns(
        {"_sun": irradiance(), "total_kwh": F.coalesce("total_kwh", F.lit(0.0)), "peak_kwh": F.coalesce("peak_kwh", F.lit(0.0))}
    )
    area = F.col("rooftop_area_sqm")
    base = F.col("total_kwh") * annual_factor(cfg.window_days)
    made = area * F.col("_sun") * cfg.panel_efficiency * cfg.performance_ratio * 365.0
    rest = F.greatest(base - made, F.lit(0.0))
    saved = (base - rest) * blended_rate(F.col("peak_kwh"), F.col("total_kwh"), cfg)
    capex = area * cfg.kw_per_sqm * cfg.capex_per_kw
    payback = F.when(saved > 0, capex / (saved / 12.0)).otherwise(9999.0)
    reason = (
        F.when(F.col("n").isNull(), "No open/confirmed finding exists for this building.")
        .when(area.isNull() | (area <= 0), "Building has no declared usable rooftop area.")
        .when(F.col("latitude").isNull() | F.col("longitude").isNull(), "Building has no declared location (latitude/longitude).")
        .when(F.col("_sun").isNull(), "SolarProvider has no irradiance data for this building's location.")
        .when(F.col("total_kwh") <= 0, "No positive building-wide consumption found in the lookback window.")
    )
    figures = _figures(base, rest, (base - rest) / base * 100.0, saved, 0.75, 1.25, payback, cfg)
    return _outcome(df, "solar_offset_v1", reason, figures, F.col("n"))


def _no_readings(what: str) -> Column:
    return F.concat(
        F.lit("Justifying finding "), F.col("finding_id"), F.lit(f" cites {what} "), F.coalesce("circuit_id", F.lit("None")),
        F.lit(", but no normalized_readings were found for it in the lookback window."),
    )


Model = Callable[[Inputs, ScenarioConfig], DataFrame]


class Registry:
    """Scenario models by name."""

    def __init__(self) -> None:
        self._models: dict[str, Model] = {}

    def add(self, name: str, model: Model) -> None:
        if name in self._models:
            raise ValueError(f"scenario model {name!r} is registered already")
        self._models[name] = model

    def items(self):
        return self._models.items()


def default_registry() -> Registry:
    r = Registry()
    r.add("load_shift_v1", load_shift)
    r.add("setpoint_adjustment_v1", setpoint_adjustment)
    r.add("solar_offset_v1", solar_offset)
    return r


# --- bounds -----------------------------------------------------------------------------------
def bounds_check(scenarios: DataFrame, cfg: ScenarioConfig = ScenarioConfig()) -> DataFrame:
    """Adds `violations`, array of (incident_type, message); empty for unavailable rows."""
    s = lambda c: F.col(c).cast("string")
    implied = (F.col("baseline_kwh") - F.col("optimized_kwh")) / F.col("baseline_kwh") * 100.0

    def broken(test: Column, kind: str, *message) -> Column:
        text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
        return F.when(test, F.struct(F.lit(kind).alias("incident_type"), text.alias("message")))

    tests = F.array(
        broken(F.col("optimized_kwh") > F.col("baseline_kwh"), "consumption_increase",
               "optimized_kwh (", s("optimized_kwh"), ") exceeds baseline_kwh (", s("baseline_kwh"), ") -- not a savings scenario."),
        broken(F.col("optimized_emissions_kg_co2") > F.col("baseline_emissions_kg_co2"), "emissions_increase",
               "optimized_emissions_kg_co2 (", s("optimized_emissions_kg_co2"), ") exceeds baseline_emissions_kg_co2 (", s("baseline_emissions_kg_co2"), ")."),
        broken((F.col("baseline_kwh") > 0) & (F.abs(implied - F.col("pct_reduction")) > 1.0), "pct_reduction_inconsistent",
               "pct_reduction (", fixed_text("pct_reduction", 2), ") does not match the reduction implied by baseline/optimized kWh (", fixed_text(implied, 2), ")."),
        broken(~F.col("pct_reduction").between(cfg.min_pct, cfg.max_pct), "pct_reduction_out_of_range",
               "pct_reduction (", fixed_text("pct_reduction", 2), f") is outside the physically plausible range [{cfg.min_pct}, {cfg.max_pct}]."),
        broken(F.col("payback_months") > cfg.max_payback, "payback_implausible",
               "payback_months (", fixed_text("payback_months", 1), f") exceeds the plausible ceiling ({cfg.max_payback})."),
    )
    found = F.filter(tests, lambda v: v.isNotNull())
    return scenarios.withColumn("violations", F.when(F.col("outcome") == "scenario", found).otherwise(F.slice(found, 1, 0)))


def _message() -> Column:
    return F.array_join(F.transform("violations", lambda v: v["message"]), "; ")


def enforce_bounds(checked: DataFrame) -> DataFrame:
    """Scenarios that broke a bound become unavailable, with the reason; nothing is clipped."""
    bad = F.size("violations") > 0
    out = {c: F.when(~bad, F.col(c)) for c in ("lead_finding_id", "n_justifying", *MONEY, "payback_months")}
    out["outcome"] = F.when(bad, "unavailable").otherwise(F.col("outcome"))
    out["reason"] = F.when(bad, F.concat(F.lit("Rejected at the service layer (bounds check failed): "), _message())).otherwise(F.col("reason"))
    return checked.withColumns(out).drop("violations")


def incidents(checked: DataFrame, as_of: Column) -> DataFrame:
    """One incident per rejected scenario, typed by its first violation."""
    kinds = F.transform("violations", lambda v: v["incident_type"])
    return checked.filter(F.size("violations") > 0).select(
        stable_id("", F.lit("incident"), "tenant_id", "building_id", "scenario_model", as_of).alias("incident_id"),
        *KEYS, "scenario_model",
        F.element_at(kinds, 1).alias("incident_type"),
        F.lit("warning").alias("severity"),
        _message().alias("message"),
        F.to_json(F.struct(kinds.alias("violation_types"))).alias("metadata"),
        as_of.alias("created_at"),
    )


# --- runs -------------------------------------------------------------------------------------
def run_models(inp: Inputs, cfg: ScenarioConfig = ScenarioConfig(), registry: Registry | None = None) -> DataFrame:
    """Every registered model over every building, bounds checked (see `enforce_bounds`, `incidents`)."""
    out = None
    for _, model in (registry or default_registry()).items():
        rows = model(inp, cfg)
        out = rows if out is None else out.unionByName(rows)
    return bounds_check(out, cfg)


def lookback(readings: DataFrame, as_of: Column, cfg: ScenarioConfig = ScenarioConfig()) -> DataFrame:
    start = as_of - F.make_dt_interval(F.lit(cfg.window_days))
    return readings.filter(F.col("ts").between(start, as_of) & F.col("data_quality_status").isin("pass", "degraded"))


def justifications(scenarios: DataFrame, findings: DataFrame) -> DataFrame:
    """(building, model, finding) rows: what each scenario rests on. Kept long, since a building may
    have any number of live findings."""
    ok = scenarios.filter("outcome = 'scenario'")
    single = ok.filter("scenario_model <> 'solar_offset_v1'").select(*KEYS, "scenario_model", F.col("lead_finding_id").alias("finding_id"))
    solar = salted_join(justifying(findings), ok.filter("scenario_model = 'solar_offset_v1'").select(*KEYS), KEYS, "left_semi").select(
        *KEYS, F.lit("solar_offset_v1").alias("scenario_model"), "finding_id"
    )
    return single.unionByName(solar)


def portfolio(scenarios: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sums per scenario model over the requested buildings, and the contributing buildings as rows.

    `members` (keys, ordinal) is the requested list; without it all buildings count.
    """
    ok = scenarios.filter("outcome = 'scenario'")
    if members is not None:
        ok = ok.join(members, KEYS)
    total = {
        "total_baseline_kwh": "baseline_kwh",
        "total_optimized_kwh": "optimized_kwh",
        "total_baseline_emissions_kg_co2": "baseline_emissions_kg_co2",
        "total_optimized_emissions_kg_co2": "optimized_emissions_kg_co2",
        "total_estimated_annual_savings_inr": "estimated_annual_savings_inr",
    }
    sums = ok.groupBy("scenario_model", "model_version").agg(
        F.count(F.lit(1)).alias("n_contributing"), *[stable_sum(c).alias(n) for n, c in total.items()]
    )
    base, best = F.col("total_baseline_kwh"), F.col("total_optimized_kwh")
    pct = F.when(base > 0, (base - best) / base * 100.0).otherwise(0.0)
    rollup = sums.withColumn("pct_reduction", half_even(pct, 2)).withColumns({n: half_even(n, 2) for n in total})
    keep = ["scenario_model", *KEYS] + (["ordinal"] if members is not None and "ordinal" in members.columns else [])
    return rollup, ok.select(*keep)


def off_peak_share(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Share of kWh outside peak hours; null when nothing was used."""
    off = stable_sum(F.when(~F.col("is_peak_hour"), F.col("kwh")).otherwise(0.0))
    return readings.groupBy(*keys).agg((F.try_divide(off, F.nullif(stable_sum("kwh"), F.lit(0.0)))).alias("ratio"))


def opt_in_prior(tenants: DataFrame, readings: DataFrame, buildings: DataFrame, building_type: str, zone: str) -> DataFrame:
    """Median off-peak share over consenting tenants for one building type and zone (one row)."""
    consent = tenants.filter("cross_tenant_aggregate_opt_in").select("tenant_id")
    kind = buildings.filter((F.col("building_type") == building_type) & (F.col("climate_zone") == zone)).select(*KEYS)
    rows = salted_join(salted_join(readings, consent, ["tenant_id"], "left_semi"), kind, KEYS, "left_semi")
    return off_peak_share(rows, ["tenant_id"]).agg(F.median("ratio").alias("prior"), F.count("ratio").alias("n_tenants"))


def consent_audit(tenants: DataFrame) -> DataFrame:
    """One audit row per tenant, consenting or not, written before any aggregation."""
    from wattloom.sinks.records import audit_rows

    return audit_rows(
        tenants, F.lit("cross_tenant_consent_check"),
        [F.col("cross_tenant_aggregate_opt_in").alias("opt_in_consent"), F.lit("cold_start_prior_aggregation").alias("pipeline")],
    )
