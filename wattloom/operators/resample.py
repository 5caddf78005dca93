"""Hourly grid, gaps and fill.

Raw readings are summed per circuit and hour first, with partial sums before the shuffle, so
that a meter holding a large share of all raw rows arrives as at most one row per hour. The grid
is then built from each observed hour and the next one: a single window over hours, no join
against a calendar of hours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import GateConfig
from wattloom.functions.scalars import hour_ceil, hour_floor, hours_seq, stable_sum

HOUR = "interval 1 hour"


def hourly_sums(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of kWh per circuit-hour (null when nothing readable), with raw row counts."""
    return raw.groupBy(*keys, hour_floor("ts").alias("ts")).agg(
        stable_sum("kwh").alias("kwh"),
        F.count(F.lit(1)).alias("raw_rows"),
        F.max("ts").alias("last_raw"),
    )


def sums_of_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`hourly_sums` from cells that divide hours (see `faults.raw_cells`)."""
    return cells.groupBy(*keys, "hour").agg(
        stable_sum("kwh").alias("kwh"), F.sum("raw_rows").alias("raw_rows"), F.max("last_raw").alias("last_raw")
    ).withColumnRenamed("hour", "ts")


def hourly_grid(raw: DataFrame, keys: Sequence[str], cfg: GateConfig = GateConfig()) -> DataFrame:
    """Dense hourly series per key with gap bounds and optional linear fill of short gaps.

    Adds `filled`, and for hours without an observation `gap_start`, `gap_end` (exclusive) and
    `gap_minutes`. Short gaps are filled only between two observations; long gaps stay empty.
    """
    return grid_of_sums(hourly_sums(raw, keys), keys, cfg)


def grid_of_sums(sums: DataFrame, keys: Sequence[str], cfg: GateConfig = GateConfig()) -> DataFrame:
    group = Window.partitionBy(*keys)
    by_hour = group.orderBy("ts")

    if cfg.legacy_grid:
        sums = sums.withColumn("_end", hour_ceil(F.max("last_raw").over(group))).filter(
            F.col("ts") < F.col("_end")
        )

    marked = sums.select(
        *keys,
        F.col("ts").alias("_hour"),
        F.col("kwh").alias("_kwh"),
        "raw_rows",
        F.min("ts").over(group).alias("_first"),
        F.max("ts").over(group).alias("_last"),
        F.count("kwh").over(group).alias("_valid"),
        F.sum("raw_rows").over(group).alias("circuit_raw_rows"),
    )
    # hours with a value carry the series; a series without any value hangs on its first hour
    held = marked.filter(
        F.col("_kwh").isNotNull() | ((F.col("_valid") == 0) & (F.col("_hour") == F.col("_first")))
    )
    order = group.orderBy("_hour")
    linked = held.withColumns(
        {
            "_prev": F.lag("_hour").over(order),
            "_next": F.lead("_hour").over(order),
            "_next_kwh": F.lead("_kwh").over(order),
        }
    )
    empty = F.col("_kwh").isNull()
    after_end = F.coalesce(F.col("_next"), F.col("_last") + F.expr(HOUR))
    before = F.when(
        F.col("_prev").isNull(), hours_seq("_first", F.col("_hour") - F.expr(HOUR))
    ).otherwise(F.array().cast("array<timestamp>"))
    after = hours_seq(F.col("_hour") + F.expr(HOUR), after_end - F.expr(HOUR))
    dense = linked.withColumn(
        "ts", F.explode(F.concat(before, F.array("_hour"), after))
    )

    observed = (F.col("ts") == F.col("_hour")) & ~empty
    gap_start = (
        F.when(observed, None)
        .when(empty, F.col("_first"))
        .when(F.col("ts") < F.col("_hour"), F.col("_first"))
        .otherwise(F.col("_hour") + F.expr(HOUR))
    )
    gap_end = (
        F.when(observed, None)
        .when(empty, F.col("_last") + F.expr(HOUR))
        .when(F.col("ts") < F.col("_hour"), F.col("_hour"))
        .otherwise(after_end)
    )
    out = dense.withColumns({"gap_start": gap_start, "gap_end": gap_end}).withColumn(
        "gap_minutes",
        ((F.unix_micros("gap_end") - F.unix_micros("gap_start")) / F.lit(60_000_000)).cast("long"),
    )

    fillable = F.lit(False)
    if cfg.gap_fill == "linear":
        fillable = (
            ~observed
            & ~empty
            & (F.col("ts") > F.col("_hour"))
            & F.col("_next").isNotNull()
            & (F.col("gap_minutes") <= cfg.max_gap_minutes)
        )
    step = (F.unix_micros("ts") - F.unix_micros("_hour")) / (
        F.unix_micros("_next") - F.unix_micros("_hour")
    )
    kwh = F.when(observed, F.col("_kwh")).when(
        fillable, F.round(F.col("_kwh") + (F.col("_next_kwh") - F.col("_kwh")) * step, 6)
    )
    return out.select(
        *keys,
        "ts",
        kwh.alias("kwh"),
        F.coalesce(fillable, F.lit(False)).alias("filled"),
        F.when(observed, F.col("raw_rows")).otherwise(F.lit(0)).cast("long").alias("raw_rows"),
        "circuit_raw_rows",
        "gap_start",
        "gap_end",
        "gap_minutes",
    )


def long_gap(cfg: GateConfig) -> Column:
    return F.coalesce(F.col("gap_minutes") > cfg.max_gap_minutes, F.lit(False))


def gap_issues(grid: DataFrame, keys: Sequence[str], cfg: GateConfig = GateConfig()) -> DataFrame:
    """One issue per long gap, from its first empty hour to the next value."""
    return grid.filter(long_gap(cfg) & (F.col("ts") == F.col("gap_start"))).select(
        *keys,
        F.lit("gap_beyond_bound").alias("issue_type"),
        F.lit("quarantined").alias("severity"),
        F.col("gap_start").alias("ts_start"),
        F.col("gap_end").alias("ts_end"),
        F.format_string(
            f"Gap of %d minutes exceeds max_interpolation_gap_minutes={cfg.max_gap_minutes}",
            F.col("gap_minutes"),
        ).alias("description"),
    )


def carry_fill(df: DataFrame, keys: Sequence[str], value: str = "kwh") -> DataFrame:
    """Last value carried forward, then the first value carried back over leading nulls."""
    w = Window.partitionBy(*keys).orderBy("ts")
    back = w.rowsBetween(0, Window.unboundedFollowing)
    ahead = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(
        value,
        F.coalesce(
            F.last(value, ignorenulls=True).over(ahead), F.first(value, ignorenulls=True).over(back)
        ),
    )
