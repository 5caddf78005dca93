"""Tenant scope, time/status filters, listings, lookups and invariant checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.config import DAY_TYPE_CODES, LAYERS, STATUSES
from wattloom.operators.skew import salted_join


def tenant_scope(df: DataFrame, tenant: str) -> DataFrame:
    """Rows of one tenant; refused for a table without the column."""
    if "tenant_id" not in df.columns:
        raise ValueError("tenant scope needs a tenant_id column")
    return df.filter(F.col("tenant_id") == tenant)


def usable_window(readings: DataFrame, start: Column, end: Column) -> DataFrame:
    """Passed and degraded readings in the closed window."""
    return readings.filter(
        F.col("ts").between(start, end) & F.col("data_quality_status").isin("pass", "degraded")
    )


def usable_rows(features: DataFrame) -> DataFrame:
    return features.filter(~F.col("low_data_quality"))


def list_findings(
    findings: DataFrame,
    tenant: str,
    building: str | None = None,
    status: str | None = None,
    min_confidence: float | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Newest findings first, one page."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")
    out = tenant_scope(findings, tenant)
    if building is not None:
        out = out.filter(F.col("building_id") == building)
    if status is not None:
        out = out.filter(F.col("status") == status)
    if min_confidence is not None:
        out = out.filter(F.col("confidence") >= min_confidence)
    out = out.orderBy(F.col("detected_at").desc(), "finding_id")
    return (out.offset(offset) if offset else out).limit(limit)


def lookup(df: DataFrame, tenant: str, **ids: str) -> DataFrame:
    out = tenant_scope(df, tenant)
    for name, value in ids.items():
        out = out.filter(F.col(name) == value)
    return out


def newest_first(df: DataFrame, stamp: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(stamp).desc(), tie)


def building_context(readings: DataFrame, buildings: DataFrame) -> DataFrame:
    """Readings with their building's rule context; unknown or undeclared baselines count as 0."""
    ctx = buildings.select(
        "tenant_id", "building_id",
        F.col("declared_unoccupied_baseline").alias("_base"),
        F.col("occupancy_schedule").alias("_sched"),
    )
    return (
        salted_join(readings, ctx, ["tenant_id", "building_id"], "left")
        .withColumn(
            "building",
            F.struct(
                F.coalesce("_base", F.lit(0.0)).alias("declared_unoccupied_baseline"),
                F.col("_sched").alias("occupancy_schedule"),
            ),
        )
        .drop("_base", "_sched")
    )


def drift_context(df: DataFrame, buildings: DataFrame) -> DataFrame:
    """Building type and zone for the drift thresholds; a missing building is an office without zone."""
    ctx = buildings.select("tenant_id", "building_id", "building_type", "climate_zone")
    return df.join(ctx, ["tenant_id", "building_id"], "left").withColumn(
        "building_type", F.coalesce("building_type", F.lit("office"))
    )


# --- invariants --------------------------------------------------------------------------------
def residual_violations(residuals: DataFrame) -> DataFrame:
    """Low-quality residual rows must carry no scores and a reason; others must carry all of them."""
    scores = [F.col(c).isNotNull() for c in ("stl_residual", "residual_zscore", "residual_magnitude")]
    some = scores[0] | scores[1] | scores[2]
    every = scores[0] & scores[1] & scores[2]
    bad = F.when(F.col("low_data_quality"), some | F.col("low_data_quality_reason").isNull()).otherwise(~every)
    return residuals.filter(bad | ~F.col("day_type").isin(*DAY_TYPE_CODES))


def bundle_violations(findings: DataFrame) -> DataFrame:
    """Findings whose bundle breaks its contract, with the broken points named."""
    b = F.col("bundle")
    layers = b["contributing_layers"]
    rule_only = F.array_distinct(layers) == F.array(F.lit("domain_rule"))
    ml_only = F.array_distinct(layers) == F.array(F.lit("ml_ensemble"))
    known = F.array(*[F.lit(x) for x in LAYERS])
    band = b["confidence_band"]
    tests = F.array(
        F.when((F.coalesce(F.size(layers), F.lit(0)) < 1), F.lit("no_layer")),
        F.when(F.size(F.array_except(layers, known)) > 0, F.lit("unknown_layer")),
        F.when(ml_only & (F.coalesce(F.size(b["rule_citations"]), F.lit(0)) > 0), F.lit("ml_only_with_citation")),
        F.when(~rule_only & (F.coalesce(F.size(b["top_features"]), F.lit(0)) < 1), F.lit("no_top_features")),
        F.when(~rule_only & band.isNull(), F.lit("no_confidence_band")),
        F.when(band["lower"] > band["upper"], F.lit("band_order")),
        F.when((band["lower"] < 0) | (band["upper"] > 1), F.lit("band_range")),
        F.when(b["evidence_window"]["start"] > b["evidence_window"]["end"], F.lit("window_order")),
    )
    return findings.withColumn("violations", F.filter(tests, lambda x: x.isNotNull())).filter(F.size("violations") > 0)



def domain_violations(readings: DataFrame) -> DataFrame:
    return readings.filter(~F.col("data_quality_status").isin(*STATUSES) | F.col("data_quality_status").isNull())


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Strict form of a check: the job fails on the first row that breaks it."""
    return df.filter(F.assert_true(condition, F.lit(message)).isNull())


def with_circuits(readings: DataFrame, circuits: DataFrame, buildings: DataFrame | None = None) -> DataFrame:
    """Readings joined with their circuit (building, type, label), and with the building's attributes if given.

    Readings carry many rows per circuit and circuits few; their key is the circuit, which the hours of a window bound.
    """
    out = readings.join(circuits.select("tenant_id", "circuit_id", "building_id", "circuit_type", "label"), ["tenant_id", "circuit_id"])
    if buildings is None:
        return out
    return salted_join(out, buildings.drop("name"), ["tenant_id", "building_id"])


def feature_window(features: DataFrame, circuits: DataFrame, start: Column, end: Column) -> DataFrame:
    """Stored feature rows of a window with the building of their circuit; the window reaches the scan."""
    rows = features.filter(F.col("ts").between(start, end))
    return rows.join(circuits.select("tenant_id", "circuit_id", "building_id"), ["tenant_id", "circuit_id"])
