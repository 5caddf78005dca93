"""Routing of domain events and suppression of repeated deliveries. Batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.scalars import composite_key

EVENT = (
    "event_id string, tenant_id string, building_id string, correlation_id string, timestamp string, event_type string, "
    "feedback_count long, trend_direction string, magnitude double"
)
ARRIVED = "building.data.arrived"
ELIGIBLE = "model.retraining.eligible"
DRIFTED = "model.drift.detected"


def parse(messages: DataFrame, value: str = "value") -> DataFrame:
    rest = [c for c in messages.columns if c not in (value, "key")]
    return messages.select(*rest, F.from_json(F.col(value).cast("string"), EVENT).alias("_e")).select(*rest, "_e.*")


def of_topic(messages: DataFrame, event_type: str, value: str = "value") -> DataFrame:
    """Events of a topic that carries one kind only: every message counts, whether or not it names its type."""
    return parse(messages, value).withColumn("event_type", F.lit(event_type))


def route(events: DataFrame, event_type: str) -> DataFrame:
    """Events of one type; others are left alone."""
    return events.filter(F.col("event_type") == event_type)


def run_key(kind: str) -> Column:
    """Key under which a delivery starts at most one run."""
    if kind == "analysis":
        return composite_key(F.lit("analysis"), "tenant_id", "building_id", "correlation_id")
    if kind == "drift":
        return composite_key(F.lit("retraining-drift"), "tenant_id", "building_id", "timestamp")
    if kind == "feedback_volume":
        return composite_key(F.lit("retraining-feedback"), "tenant_id", "building_id", F.col("feedback_count").cast("string"))
    raise ValueError(f"unknown run kind {kind!r}")


def once(events: DataFrame, kind: str, delay: str = "1 day") -> DataFrame:
    """Each derived key once: within the watermark on a stream, over everything in a batch."""
    keyed = events.withColumn("dedupe_key", run_key(kind))
    if events.isStreaming:
        stamped = keyed.withColumn("event_time", F.try_to_timestamp("timestamp"))
        return stamped.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["dedupe_key"])
    return keyed.dropDuplicates(["dedupe_key"])


def triggers(events: DataFrame, kind: str) -> DataFrame:
    return once(events, kind).select("tenant_id", "building_id", F.lit(kind).alias("trigger"), "dedupe_key")
