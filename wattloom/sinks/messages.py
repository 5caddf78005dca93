"""Outgoing events and alerts as rows: `key`, `value` (JSON), ready for any message sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.config import RETRAIN_AT_LABELS
from wattloom.functions.scalars import drop_null_entries, iso_text, stable_id


def keyed(df: DataFrame, key: str, fields: list[Column]) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def data_arrived(batches: DataFrame, as_of: Column) -> DataFrame:
    """One event per batch that passed or was degraded; quarantined batches stay silent."""
    event = stable_id("", F.lit("data_arrived"), "tenant_id", "building_id", "batch_id")
    return keyed(
        batches.filter(F.col("overall_status").isin("pass", "degraded")),
        "tenant_id",
        [
            event.alias("event_id"),
            F.col("tenant_id"),
            F.col("building_id"),
            F.col("batch_id").alias("correlation_id"),
            iso_text(as_of).alias("timestamp"),
            F.lit("building.data.arrived").alias("event_type"),
            F.col("overall_status").alias("data_quality_status"),
            F.col("total_rows").alias("batch_row_count"),
            F.col("ingestion_source"),
        ],
    )


def drift_detected(results: DataFrame, as_of: Column) -> DataFrame:
    return keyed(
        results.filter("status = 'drifting'"),
        "building_id",
        [
            F.col("tenant_id"),
            F.col("building_id"),
            F.col("trend_direction"),
            F.col("magnitude"),
            iso_text(as_of).alias("timestamp"),
        ],
    )


def stale_baseline_notices(results: DataFrame) -> DataFrame:
    return keyed(
        results.filter("status = 'drifting'"),
        "building_id",
        [
            F.col("tenant_id"),
            F.col("building_id"),
            F.lit("baseline_stale").alias("notification_type"),
            F.lit("The building's baseline behavior has drifted and may be stale.").alias("message"),
        ],
    )


def retraining_eligible(crossings: DataFrame) -> DataFrame:
    """Events for buildings whose label count has just reached the threshold."""
    return keyed(
        crossings,
        "tenant_id",
        [
            F.col("tenant_id"),
            F.col("building_id"),
            iso_text("created_at").alias("timestamp"),
            F.lit("model.retraining.eligible").alias("event_type"),
            F.lit(RETRAIN_AT_LABELS).alias("feedback_count"),
            F.lit(RETRAIN_AT_LABELS).alias("retraining_threshold"),
        ],
    )


def quality_alerts(batches: DataFrame, issues: DataFrame) -> DataFrame:
    """Critical alert for a wholly quarantined batch, otherwise a warning when its schema drifted.

    Per batch there is at most one drift text and a handful of issue types; counts are summed
    before the shuffle.
    """
    drift = F.col("issue_type") == "schema_drift"
    per_batch = issues.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("_issues"),
        F.count_if(drift).alias("_drifts"),
        F.array_join(F.array_sort(F.collect_set(F.when(drift, F.col("description")))), "; ").alias("_texts"),
        F.array_join(F.array_sort(F.collect_set("issue_type")), ", ").alias("_types"),
    )
    b = batches.join(per_batch, "batch_id", "left").fillna(0, ["_issues", "_drifts"]).fillna("", ["_texts", "_types"])
    stopped = F.col("overall_status") == "quarantined"
    s = lambda c: F.col(c).cast("string")
    meta = F.create_map(
        F.lit("total_rows"), F.when(stopped, s("total_rows")),
        F.lit("quarantined_count"), F.when(stopped, s("quarantined_count")),
        F.lit("issue_types"), F.when(stopped, F.col("_types")),
        F.lit("drift_count"), F.when(~stopped, s("_drifts")),
        F.lit("data_quality_status"), F.when(~stopped, F.col("overall_status")),
    )
    return b.filter(stopped | (F.col("_drifts") > 0)).select(
        "tenant_id",
        "building_id",
        "batch_id",
        F.when(stopped, "quarantined_batch").otherwise("schema_drift").alias("alert_type"),
        F.when(stopped, "critical").otherwise("warning").alias("severity"),
        F.when(
            stopped,
            F.concat(
                F.lit("Entire batch quarantined: "), s("quarantined_count"),
                F.lit(" rows. No downstream analysis triggered. Issues: "), s("_issues"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Schema drift detected in ingestion batch: "), F.col("_texts"),
                F.lit(". Data accepted as degraded — review source schema."),
            )
        )
        .alias("message"),
        F.to_json(drop_null_entries(meta)).alias("metadata"),
    )
