"""Retention and erasure as set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.scalars import days_before, iso_text
from wattloom.operators.skew import salted_join
from wattloom.sinks.records import audit_rows

BUILDING = ["tenant_id", "building_id"]


def cutoffs(tenants: DataFrame, as_of: Column) -> DataFrame:
    """Tenants with a retention policy and the instant before which readings expire."""
    kept = tenants.filter(F.col("readings_retention_days").isNotNull())
    return kept.select("tenant_id", "readings_retention_days", days_before(as_of, "readings_retention_days").alias("cutoff"))


def expired(readings: DataFrame, limits: DataFrame) -> DataFrame:
    """Dry run: expired readings per tenant with a policy."""
    # counted per instant first: a large tenant meets its policy row as counts, not as readings
    instants = readings.groupBy("tenant_id", "ts").agg(F.count(F.lit(1)).alias("_n"))
    return limits.join(instants, "tenant_id", "left").groupBy("tenant_id", "readings_retention_days").agg(
        F.coalesce(F.sum(F.when(F.col("ts") < F.col("cutoff"), F.col("_n"))), F.lit(0)).alias("n_expired")
    )


def retained(readings: DataFrame, limits: DataFrame) -> DataFrame:
    """Readings that stay: younger than the cutoff, or of tenants without a policy."""
    return salted_join(readings, limits.select("tenant_id", "cutoff"), ["tenant_id"], "left").filter(
        F.col("cutoff").isNull() | (F.col("ts") >= F.col("cutoff"))
    ).drop("cutoff")


def retention_audit(limits: DataFrame) -> DataFrame:
    return audit_rows(
        limits, F.lit("retention.enforcement"), [F.col("readings_retention_days"), iso_text("cutoff").alias("cutoff")]
    )


def require_owned(targets: DataFrame, buildings: DataFrame) -> DataFrame:
    """Targets (BUILDING) checked against the building table; a foreign building fails the job."""
    owned = targets.join(buildings.select(*BUILDING, "name"), BUILDING, "left")
    text = F.concat(F.lit("Building "), F.col("building_id"), F.lit(" not found for tenant "), F.col("tenant_id"))
    return owned.filter(F.assert_true(F.col("name").isNotNull(), text).isNull())


def tenant_targets(tenants: DataFrame, buildings: DataFrame) -> DataFrame:
    """All buildings of the given tenants."""
    return buildings.join(tenants.select("tenant_id"), "tenant_id", "left_semi").select(*BUILDING)


def erase(tables: dict[str, DataFrame], targets: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Survivors of every table and deleted counts per building.

    Tables: buildings, circuits, readings, calendar, findings, feedback. Every table is filtered
    once, whatever the number of buildings; a circuit tree goes as a whole.
    """
    t = targets.select(*BUILDING).distinct()
    gone_circuits = tables["circuits"].join(t, BUILDING, "left_semi").select("tenant_id", "building_id", "circuit_id").distinct()
    gone_findings = salted_join(tables["findings"], t, BUILDING, "left_semi").select("building_id", "tenant_id", "finding_id")
    out = {n: salted_join(tables[n], t, BUILDING, "left_anti") for n in ("buildings", "circuits", "calendar", "findings")}
    out["readings"] = tables["readings"].join(gone_circuits, ["tenant_id", "circuit_id"], "left_anti")
    out["feedback"] = tables["feedback"].join(gone_findings.select("finding_id"), "finding_id", "left_anti")

    # readings and labels are counted by their own key before they meet the erased keys
    per_circuit = tables["readings"].groupBy("tenant_id", "circuit_id").agg(F.count(F.lit(1)).alias("n"))
    per_finding = tables["feedback"].groupBy("finding_id").agg(F.count(F.lit(1)).alias("n"))
    counted = (
        gone_findings.select(*BUILDING, F.lit("findings").alias("what"), F.lit(1).alias("n"))
        .unionByName(gone_findings.join(per_finding, "finding_id").select(*BUILDING, F.lit("feedback").alias("what"), "n"))
        .unionByName(gone_circuits.join(per_circuit, ["tenant_id", "circuit_id"]).select(*BUILDING, F.lit("readings").alias("what"), "n"))
        .unionByName(tables["calendar"].join(t, BUILDING, "left_semi").select(*BUILDING, F.lit("calendar").alias("what"), F.lit(1).alias("n")))
        .unionByName(gone_circuits.select(*BUILDING, F.lit("circuits").alias("what"), F.lit(1).alias("n")))
    )
    sums = counted.groupBy(*BUILDING).agg(
        *[F.sum(F.when(F.col("what") == w, F.col("n")).otherwise(0)).cast("long").alias(f"{w}_deleted")
          for w in ("feedback", "findings", "readings", "calendar", "circuits")]
    )
    named = t.join(tables["buildings"].select(*BUILDING, "name"), BUILDING)
    report = named.join(sums, BUILDING, "left").fillna(0)
    return out, report


def erase_audit(report: DataFrame) -> DataFrame:
    """Start and completion rows per erased building; the audit log itself is never erased."""
    start = audit_rows(report, F.lit("building.data.deleted"), [F.col("name").alias("building_name"), F.col("building_id"), F.col("tenant_id")], F.col("building_id"))
    counts = [F.col(f"{w}_deleted") for w in ("feedback", "findings", "readings", "calendar")]
    done = audit_rows(report, F.lit("building.data.deletion_completed"), [F.col("name").alias("building_name"), *counts], F.col("building_id"))
    return start.unionByName(done)


def tenant_audit(tenants: DataFrame) -> DataFrame:
    rows = [audit_rows(tenants, F.lit(e), [F.col("name").alias("tenant_name")], F.col("tenant_id"))
            for e in ("tenant.data.deletion_initiated", "tenant.data.deletion_completed")]
    return rows[0].unionByName(rows[1])


def erase_tenants(tables: dict[str, DataFrame], tenants: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Erases all buildings of the tenants and the tenants' own rows; returns audit rows too."""
    gone = tables["tenants"].join(tenants.select("tenant_id"), "tenant_id", "left_semi")
    left, report = erase(tables, tenant_targets(tenants, tables["buildings"]))
    left["tenants"] = tables["tenants"].join(tenants.select("tenant_id"), "tenant_id", "left_anti")
    return left, tenant_audit(gone).unionByName(erase_audit(report))
