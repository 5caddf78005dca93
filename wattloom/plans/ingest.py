"""Dataset ingestion: all files of a source through the gate in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.config import GateConfig
from wattloom.functions.scalars import stable_id
from wattloom.operators.gate import BATCH, GateResult, normalize_rows, quality_gate, schema_drift
from wattloom.sources.bounds import built_in_bounds
from wattloom.sources.meters import read_meter_csv
from wattloom.sources.presets import expectation_table, preset, resolve_columns


def dataset_summary(result: GateResult) -> DataFrame:
    """Sums of the batch verdicts per source."""
    sums = [F.sum(c).alias(c) for c in ("total_rows", "pass_count", "degraded_count", "quarantined_count")]
    return result.batches.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_batches"), *sums,
        F.count_if(F.col("overall_status") == "quarantined").alias("quarantined_batches"),
    )


def ingest_dataset(
    spark: SparkSession, path: str, source_id: str, tenant: str, building: str, zone: str = "UTC",
    default_type: str = "main_feed", cfg: GateConfig = GateConfig(),
) -> GateResult:
    """Reads CSV files of a named source and gates them as one batch."""
    text = read_meter_csv(spark, path)
    raw_columns = text.columns
    source = preset(source_id)
    rows = resolve_columns(text, source)
    batch = stable_id("", F.lit(tenant), F.lit(building), F.lit(path))
    manifest = spark.range(1).select(
        F.lit(tenant).alias("tenant_id"), F.lit(building).alias("building_id"), batch.alias("batch_id"),
        F.lit(source_id).alias("source_id"), F.array(*[F.lit(c) for c in raw_columns]).alias("columns"),
    )
    drift = schema_drift(manifest, expectation_table(spark))
    lacking = {"ts", "kwh", "circuit_id"} - set(rows.columns)
    if lacking:
        empty = "tenant_id string, building_id string, batch_id string, circuit_id string, circuit_type string, ingestion_source string, ts timestamp, kwh double"
        typed = spark.createDataFrame([], empty)
        note = "Required columns missing after mapping: " + ", ".join(sorted(lacking & {"ts", "kwh"}))
        if lacking == {"circuit_id"}:
            note = "No circuit identifier column found after mapping"
        drift = drift.unionByName(
            manifest.select(*BATCH, F.lit("missing_columns").alias("issue_type"), F.lit("quarantined").alias("severity"), F.lit(note).alias("description"))
        )
    else:
        kind = F.col("circuit_type") if "circuit_type" in rows.columns else F.lit(None).cast("string")
        typed = normalize_rows(
            rows.select(
                F.lit(tenant).alias("tenant_id"), F.lit(building).alias("building_id"), batch.alias("batch_id"), "circuit_id",
                F.coalesce(kind, F.lit(default_type)).alias("circuit_type"), F.lit("csv_upload").alias("ingestion_source"),
                "ts", "kwh", F.lit(zone).alias("source_timezone"),
            )
        ).drop("source_timezone")
    return quality_gate(typed, manifest.drop("columns"), built_in_bounds(spark), drift, cfg)
