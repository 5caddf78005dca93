"""Outliers, stuck sensors and dropouts on hourly or raw series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import GateConfig
from wattloom.functions.scalars import fixed_text, minutes_between

ISSUE_FIELDS = ("issue_type", "severity", "ts_start", "ts_end", "description")


def outlier_scores(readings: DataFrame, keys: Sequence[str], cfg: GateConfig = GateConfig()) -> DataFrame:
    """Adds `zscore` over the last hours with a value, and `is_outlier`.

    Rows without a value sit in their own window groups, so they neither take a place in the
    frame nor cost a second shuffle.
    """
    series = Window.partitionBy(*keys, F.col("kwh").isNull())
    frame = series.orderBy("ts").rowsBetween(-(cfg.outlier_window - 1), 0)
    spread = F.stddev_samp("kwh").over(frame)
    ready = (
        F.col("kwh").isNotNull()
        & (F.count("kwh").over(series) >= cfg.outlier_window)
        & (F.count("kwh").over(frame) >= max(1, cfg.outlier_window // 2))
    )
    z = F.when(ready & (spread > 0), (F.col("kwh") - F.avg("kwh").over(frame)) / spread)
    return readings.withColumn("zscore", F.coalesce(z, F.lit(0.0))).withColumn(
        "is_outlier", F.abs("zscore") > cfg.outlier_z
    )


def outlier_issues(scored: DataFrame, keys: Sequence[str], cfg: GateConfig = GateConfig()) -> DataFrame:
    return scored.filter("is_outlier").select(
        *keys,
        F.lit("outlier").alias("issue_type"),
        F.lit("degraded").alias("severity"),
        F.col("ts").alias("ts_start"),
        (F.col("ts") + F.expr("interval 1 hour")).alias("ts_end"),
        F.concat(
            F.lit("Rolling Z-score "), fixed_text("zscore", 2), F.lit(f" exceeds threshold {cfg.outlier_z}")
        ).alias("description"),
    )


def _by_type(cfg: GateConfig, pick) -> Column:
    expr = None
    for name, rule in cfg.stuck_rules.items():
        test = F.col("circuit_type") == name
        expr = F.when(test, pick(rule)) if expr is None else expr.when(test, pick(rule))
    default = pick(cfg.stuck_default)
    return F.lit(default) if expr is None else expr.otherwise(default)


def stuck_issues(readings: DataFrame, keys: Sequence[str], cfg: GateConfig = GateConfig()) -> DataFrame:
    """Runs of windows whose variance stays at or below the circuit type's threshold."""
    rules = list(cfg.stuck_rules.values()) + [cfg.stuck_default]
    sizes = sorted({r.window for r in rules})
    series = Window.partitionBy(*keys).orderBy("ts")
    size = _by_type(cfg, lambda r: F.lit(r.window))

    def at_size(make):
        expr = None
        for n in sizes:
            value = make(series.rowsBetween(-(n - 1), 0))
            expr = F.when(size == n, value) if expr is None else expr.when(size == n, value)
        return expr

    low = at_size(lambda frame: F.var_pop("kwh").over(frame))
    flagged = readings.filter(F.col("kwh").isNotNull()).select(
        *keys,
        "circuit_type",
        "ts",
        F.row_number().over(series).alias("_n"),
        size.alias("_size"),
        low.alias("_var"),
        at_size(lambda frame: F.first("ts").over(frame)).alias("_from"),
        at_size(lambda frame: F.first("kwh").over(frame)).alias("_value"),
        _by_type(cfg, lambda r: F.lit(r.variance)).alias("_limit"),
        _by_type(cfg, lambda r: F.lit(r.hours)).alias("_hours"),
    )
    still = flagged.filter((F.col("_n") >= F.col("_size")) & (F.col("_var") <= F.col("_limit")))
    # consecutive row numbers share one island
    runs = (
        still.withColumn("_run", F.col("_n") - F.row_number().over(series))
        .groupBy(*keys, "circuit_type", "_hours", "_run")
        .agg(
            F.min("_from").alias("ts_start"),
            F.max("ts").alias("ts_end"),
            F.min_by("_value", "ts").alias("_stuck"),
        )
        .withColumn("_lasted", minutes_between("ts_start", "ts_end") / 60)
        .filter(F.col("_lasted") >= F.col("_hours"))
    )
    return runs.select(
        *keys,
        F.lit("stuck_at_value").alias("issue_type"),
        F.when(F.col("circuit_type") == "main_feed", "quarantined").otherwise("degraded").alias("severity"),
        "ts_start",
        "ts_end",
        F.concat(
            F.lit("Stuck at "), fixed_text("_stuck", 2), F.lit(" kWh for "), fixed_text("_lasted", 1),
            F.lit("h (threshold: "), F.col("_hours").cast("string"), F.lit("h for "),
            F.col("circuit_type"), F.lit(")"),
        ).alias("description"),
    )


def allowed_gap_minutes(source: str, cfg: GateConfig) -> Column:
    return expected_minutes(source, cfg) * F.lit(cfg.dropout_factor)


def expected_minutes(source: str, cfg: GateConfig) -> Column:
    expr = None
    for name, minutes in cfg.expected_minutes.items():
        test = F.col(source) == name
        expr = F.when(test, minutes) if expr is None else expr.when(test, minutes)
    return F.lit(cfg.expected_default) if expr is None else expr.otherwise(cfg.expected_default)


def dropout_issues(
    raw: DataFrame, keys: Sequence[str], cfg: GateConfig = GateConfig(), source: str = "ingestion_source"
) -> DataFrame:
    """Gaps between consecutive raw stamps above the tolerated multiple of the expected interval.

    See `raw_cells` for why first and last stamps suffice.
    """
    return dropouts_of_cells(raw_cells(raw, _series(keys, source), cfg, source), keys, cfg, source)


def _series(keys: Sequence[str], source: str) -> list[str]:
    return [*keys] if source in keys else [*keys, source]


def raw_cells(
    raw: DataFrame, series: Sequence[str], cfg: GateConfig = GateConfig(), source: str = "ingestion_source"
) -> DataFrame:
    """Raw rows summed into cells that divide hours and are no wider than the tolerated gap.

    Two stamps further apart than the tolerated gap cannot share a cell, so the first and last stamp
    of each cell show the same gaps as all stamps do; and hours are sums of cells. One scan and one
    shuffle of the raw rows thus serve both, and a busy meter leaves them as a bounded number of rows.
    """
    width = (allowed_gap_minutes(source, cfg) * F.lit(60_000_000)).cast("long")
    return raw.filter(F.col("ts").isNotNull()).groupBy(
        *series, F.date_trunc("hour", "ts").alias("hour"), F.floor(F.unix_micros("ts") / width).alias("slot")
    ).agg(
        F.sum("kwh").alias("kwh"), F.count(F.lit(1)).alias("raw_rows"), F.min("ts").alias("first_raw"), F.max("ts").alias("last_raw")
    )


def dropouts_of_cells(
    cells: DataFrame, keys: Sequence[str], cfg: GateConfig = GateConfig(), source: str = "ingestion_source"
) -> DataFrame:
    limit = allowed_gap_minutes(source, cfg)
    w = Window.partitionBy(*_series(keys, source)).orderBy("first_raw")
    gaps = (
        cells.withColumn("ts_start", F.lag("last_raw").over(w))
        .withColumn("_minutes", minutes_between("ts_start", "first_raw"))
        .filter(F.col("_minutes") > limit)
    )
    return gaps.select(
        *keys,
        F.lit("dropout").alias("issue_type"),
        F.lit("degraded").alias("severity"),
        "ts_start",
        F.col("first_raw").alias("ts_end"),
        F.concat(
            F.lit("Reporting gap of "), fixed_text("_minutes", 0), F.lit(" min exceeds "),
            fixed_text(limit, 0), F.lit(f" min ({cfg.dropout_factor}x expected "),
            expected_minutes(source, cfg).cast("string"), F.lit(" min for "), F.col(source), F.lit(")"),
        ).alias("description"),
    )


def sensor_faults(
    readings: DataFrame, cells: DataFrame, keys: Sequence[str], cfg: GateConfig = GateConfig()
) -> DataFrame:
    """Stuck runs of the hourly readings and dropouts of the raw cells."""
    return stuck_issues(readings, keys, cfg).unionByName(dropouts_of_cells(cells, keys, cfg))
