"""Day types per building and date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.sinks.merge import CALENDAR_KEY, upsert

KEYS = list(CALENDAR_KEY)


def date_grid(buildings: DataFrame, first: str, last: str) -> DataFrame:
    """Every date of the closed range for every building."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return buildings.select("tenant_id", "building_id", F.explode(days).alias("date"))


def uncovered_weekends(grid: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weekend dates that the calendar does not mention yet."""
    return (
        grid.filter(F.weekday("date") >= 5)
        .join(calendar, KEYS, "left_anti")
        .select(*KEYS, F.lit("weekend").alias("day_type"), F.lit("auto:weekday_check").alias("source"))
    )


def entries(rows: DataFrame, day_type: str, seq: int) -> DataFrame:
    return rows.select(*KEYS, F.lit(day_type).alias("day_type"), "source", F.lit(seq).alias("batch_seq"))


def upsert_calendar(calendar: DataFrame, incoming: DataFrame) -> DataFrame:
    """Day types merged by (tenant, building, date); the last writer wins."""
    return upsert(calendar, incoming, CALENDAR_KEY, order=("batch_seq", "source"))


def build_calendar(
    buildings: DataFrame, holidays: DataFrame, closures: DataFrame, first: str, last: str
) -> DataFrame:
    """Holidays, then closures over them, weekends where neither applies, business days elsewhere.

    `holidays` (date, source) hold for all buildings; `closures` carry tenant and building.
    """
    grid = date_grid(buildings, first, last)
    public = grid.join(holidays, "date").select(*KEYS, F.lit("holiday").alias("day_type"), "source", F.lit(1).alias("batch_seq"))
    declared = grid.join(closures, KEYS).select(
        *KEYS, F.lit("declared_closure").alias("day_type"), "source", F.lit(2).alias("batch_seq")
    )
    rest = grid.select(
        *KEYS,
        F.when(F.weekday("date") >= 5, "weekend").otherwise("business_day").alias("day_type"),
        F.when(F.weekday("date") >= 5, "auto:weekday_check").otherwise("auto:remainder").alias("source"),
        F.lit(0).alias("batch_seq"),
    )
    every = rest.unionByName(public).unionByName(declared)
    return every.groupBy(*KEYS).agg(
        F.max_by(F.struct("day_type", "source"), F.struct("batch_seq", "source")).alias("_d")
    ).select(*KEYS, "_d.*")


def with_day_type(readings: DataFrame, calendar: DataFrame, zone: str | None = None) -> DataFrame:
    """Readings with the day type of their date: the UTC date, or the date in `zone` (a column)."""
    local = F.from_utc_timestamp("ts", F.col(zone)) if zone else F.col("ts")
    return (
        readings.withColumn("date", F.to_date(local))
        .join(calendar.select(*KEYS, "day_type"), KEYS, "left")
        .drop("date")
    )


def complete_circuits(dated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings of circuits whose dates are all covered, and the circuits that are not."""
    gaps = dated.filter(F.col("day_type").isNull()).groupBy("tenant_id", "circuit_id").agg(
        F.min(F.to_date("ts")).alias("missing_date")
    )
    return dated.join(gaps, ["tenant_id", "circuit_id"], "left_anti"), gaps
