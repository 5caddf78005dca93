"""Data-quality gate over many batches at once.

Plan: raw rows -> cells -> hourly sums -> grid -> per-row checks in one projection; only interval issues
(stuck, dropout) and whole-batch issues come back. Interval issues meet the readings in a sweep over
their starts and ends, in buckets of time, so no range join is planned and no interval is spelled out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import DEFAULT_BOUNDS, NORMALIZATION_VERSION, SCHEMA_VERSION, GateConfig
from wattloom.functions.scalars import (
    digest16,
    fixed_text,
    name_key,
    rank_status,
    status_rank,
    stable_sum,
    to_number,
    to_utc,
)
from wattloom.operators.faults import outlier_issues, outlier_scores, raw_cells, sensor_faults
from wattloom.operators.resample import gap_issues, grid_of_sums, long_gap, sums_of_cells
from wattloom.operators.skew import salted_join
from wattloom.session import store_table
from wattloom.sources.presets import with_preset

BATCH = ("tenant_id", "building_id", "batch_id")
KEYS = (*BATCH, "circuit_id")


@dataclass
class GateResult:
    readings: DataFrame
    issues: DataFrame
    batches: DataFrame


# --- raw rows --------------------------------------------------------------------------------
def normalize_rows(df: DataFrame, zone: str = "source_timezone") -> DataFrame:
    """Text columns to typed ones: instants in UTC, numbers or null."""
    return df.withColumns({"ts": to_utc("ts", F.col(zone)), "kwh": to_number("kwh")})


def raw_stamps(df: DataFrame) -> DataFrame:
    """Rows of mapped circuits with a readable stamp."""
    return df.filter(F.col("ts").isNotNull() & F.col("circuit_id").isNotNull())


# --- manifests: one row per batch with its raw column names ---------------------------------
def missing_columns(manifests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Batches lacking a required canonical column; timestamp and kWh are named before the circuit."""
    have = resolved.groupBy("batch_id").agg(F.collect_set("column").alias("_have"))
    checked = manifests.join(have, "batch_id", "left").withColumn(
        "_lack", F.array_sort(F.array_except(F.array(F.lit("kwh"), F.lit("ts")), "_have"))
    )
    no_circuit = ~F.array_contains("_have", "circuit_id")
    return checked.filter((F.size("_lack") > 0) | no_circuit).select(
        *BATCH,
        F.lit("missing_columns").alias("issue_type"),
        F.lit("quarantined").alias("severity"),
        F.when(
            F.size("_lack") > 0,
            F.concat(F.lit("Required columns missing after mapping: "), F.array_join("_lack", ", ")),
        )
        .otherwise("No circuit identifier column found after mapping")
        .alias("description"),
    )


def _listing(arr) -> Column:
    return F.concat(
        F.lit("["), F.array_join(F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")
    )


def schema_drift(manifests: DataFrame, expectations: DataFrame) -> DataFrame:
    """Missing required columns quarantine a batch; other missing or extra columns degrade it."""
    low = lambda a: F.array_distinct(F.transform(a, name_key))
    m = with_preset(manifests, expectations)
    m = m.withColumns({"_have": low(F.col("columns")), "_want": low(F.col("expected")), "_must": low(F.col("required"))})
    m = m.withColumns(
        {
            "_missing": F.array_sort(F.array_except("_want", "_have")),
            "_extra": F.array_sort(F.array_except("_have", "_want")),
        }
    ).withColumn("_fatal", F.array_sort(F.array_intersect("_must", "_missing")))
    changes = F.concat_ws(
        ", ",
        F.when(F.size("_missing") > 0, F.concat(F.lit("missing="), _listing(F.col("_missing")))),
        F.when(F.size("_extra") > 0, F.concat(F.lit("unexpected="), _listing(F.col("_extra")))),
    )
    source = F.concat(F.lit("'"), F.col("source_id"), F.lit("': "))
    fatal = F.size("_fatal") > 0
    return m.filter((F.size("_missing") > 0) | (F.size("_extra") > 0)).select(
        *BATCH,
        F.lit("schema_drift").alias("issue_type"),
        F.when(fatal, "quarantined").otherwise("degraded").alias("severity"),
        F.when(
            fatal,
            F.concat(F.lit("Required columns missing for source "), source, _listing(F.col("_fatal"))),
        )
        .otherwise(F.concat(F.lit("Schema drift detected for source "), source, changes))
        .alias("description"),
    )


def schema_fingerprint(columns, types=None) -> Column:
    """16 hex digits over the sorted lower-cased names, and optionally a name -> type map."""
    quoted = lambda a: F.array_join(
        F.transform(a, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "
    )
    names = F.array_sort(F.transform(columns, name_key))
    body = F.concat(F.lit('{"columns": ['), quoted(names), F.lit("]"))
    if types is not None:
        pairs = F.array_sort(F.transform(F.map_entries(types), lambda e: F.struct(name_key(e["key"]).alias("k"), e["value"].alias("v"))))
        text = F.array_join(
            F.transform(pairs, lambda e: F.concat(F.lit('"'), e["k"], F.lit('": "'), e["v"], F.lit('"'))), ", "
        )
        body = F.concat(body, F.lit(', "types": {'), text, F.lit("}"))
    return digest16(F.concat(body, F.lit("}")))


def unmapped_circuits(raw: DataFrame, circuits: DataFrame, meter: str = "meter_id") -> DataFrame:
    """One quarantined issue per raw meter of a batch that no circuit answers to."""
    meters = raw.select(*BATCH, F.col(meter).alias("_meter")).distinct()
    known = circuits.select("tenant_id", "building_id", F.col("label").alias("_meter")).distinct()
    return meters.join(known, ["tenant_id", "building_id", "_meter"], "left_anti").select(
        *BATCH,
        F.lit("unmapped_circuit").alias("issue_type"),
        F.lit("quarantined").alias("severity"),
        F.concat(F.lit("Raw meter ID '"), F.col("_meter"), F.lit("' not found in circuit_map")).alias("description"),
    )


# --- plausibility ---------------------------------------------------------------------------
def with_bounds(readings: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds min_kwh/max_kwh: the circuit type's bounds, or the `__default__` row's."""
    default = bounds.filter("circuit_type = '__default__'")
    low = default.agg(F.coalesce(F.first("min_kwh"), F.lit(DEFAULT_BOUNDS[0]))).scalar()
    high = default.agg(F.coalesce(F.first("max_kwh"), F.lit(DEFAULT_BOUNDS[1]))).scalar()
    table = bounds.filter("circuit_type <> '__default__'").select(
        "circuit_type", F.col("min_kwh").alias("_min"), F.col("max_kwh").alias("_max")
    )
    # one row per circuit type, so Spark broadcasts it by its size; the defaults are scalar subqueries
    return (
        readings.join(table, "circuit_type", "left")
        .withColumns({"min_kwh": F.coalesce("_min", low), "max_kwh": F.coalesce("_max", high)})
        .drop("_min", "_max")
    )


def implausible() -> Column:
    outside = (F.col("kwh") < F.col("min_kwh")) | (F.col("kwh") > F.col("max_kwh"))
    return F.coalesce(outside, F.lit(False))


def bounds_issues(bounded: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return bounded.filter(implausible()).select(
        *keys,
        F.lit("implausible_value").alias("issue_type"),
        F.lit("quarantined").alias("severity"),
        F.col("ts").alias("ts_start"),
        F.col("ts").alias("ts_end"),
        F.concat(
            F.lit("Value "), fixed_text("kwh", 2), F.lit(" kWh outside bounds ["),
            F.col("min_kwh").cast("string"), F.lit(", "), F.col("max_kwh").cast("string"),
            F.lit("] for circuit_type="), F.col("circuit_type"),
        ).alias("description"),
    )


# --- issues onto readings ---------------------------------------------------------------------
BUCKET_DAYS = 30


def covering_rank(readings: DataFrame, intervals: DataFrame, keys: Sequence[str] = KEYS, tasks: int | None = None) -> DataFrame:
    """Adds `_issue_rank`: the worst severity of the closed intervals (ts_start, ts_end; without an end the start alone) that cover a reading's stamp, whatever stamps there are.

    A sweep in the order of time counts the intervals of each severity that are open: an interval is a start and an end, not its hours. Time is cut into buckets of
    BUCKET_DAYS, in each of which an interval that reaches into it stands once, so a long interval is few rows and a long series many small groups. `tasks`: how many
    share the sweep, where the number of readings is known.
    """
    width = F.lit(BUCKET_DAYS * 86_400_000_000)
    bucket = lambda c: F.floor(F.unix_micros(c) / width)
    end = F.coalesce("ts_end", "ts_start")
    spans = intervals.filter(F.col("ts_start") <= end).select(
        *keys, status_rank("severity").alias("_rank"), F.explode(F.sequence(bucket(F.col("ts_start")), bucket(end))).alias("_bucket"),
        F.array(F.struct(F.col("ts_start").alias("ts"), F.lit(0).alias("_kind"), F.lit(1).alias("_d")), F.struct(end.alias("ts"), F.lit(2).alias("_kind"), F.lit(-1).alias("_d"))).alias("_e"),
    )
    edges = spans.select(*keys, "_bucket", "_rank", F.explode("_e").alias("_e")).select(*keys, "_bucket", "_rank", "_e.*")
    # equal edges are summed first, so that many intervals that begin together are one row
    edges = edges.groupBy(*keys, "_bucket", "ts", "_kind").agg(*[F.sum(F.when(F.col("_rank") == r, F.col("_d")).otherwise(0)).alias(f"_d{r}") for r in (1, 2)])
    rows = readings.withColumns({"_bucket": bucket(F.col("ts")), "_kind": F.lit(1), "_d1": F.lit(0).cast("long"), "_d2": F.lit(0).cast("long")})
    sweep = Window.partitionBy(*keys, "_bucket").orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(edges, allowMissingColumns=True)
    if tasks is not None:
        both = both.repartition(tasks, *keys, "_bucket")
    open_ = lambda r: F.sum(f"_d{r}").over(sweep) > 0
    both = both.withColumn("_issue_rank", F.when(open_(2), 2).when(open_(1), 1).otherwise(0))
    return both.filter(F.col("_kind") == 1).select(*readings.columns, "_issue_rank")


def apply_issues(readings: DataFrame, intervals: DataFrame, keys: Sequence[str] = KEYS,
                 whole: DataFrame | None = None, scope: Sequence[str] = BATCH,
                 circuits: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Raises each reading's status to the worst issue that covers it.

    `intervals` hold circuit and time, `circuits` only a circuit, `whole` neither.
    """
    out = covering_rank(readings, intervals, keys, tasks)
    ranks = [status_rank("data_quality_status"), F.col("_issue_rank")]
    if circuits is not None:
        worst = circuits.groupBy(*keys).agg(F.max(status_rank("severity")).alias("_circuit_rank"))
        out = out.join(worst, list(keys), "left")
        ranks.append(F.coalesce("_circuit_rank", F.lit(0)))
    if whole is not None:
        worst = whole.groupBy(*scope).agg(F.max(status_rank("severity")).alias("_batch_rank"))
        out = salted_join(out, worst, scope, "left")
        ranks.append(F.coalesce("_batch_rank", F.lit(0)))
    return out.withColumn("data_quality_status", rank_status(F.greatest(*ranks))).drop(
        "_issue_rank", "_circuit_rank", "_batch_rank"
    )


def fill_ratio(grid: DataFrame, scope: Sequence[str] = BATCH) -> DataFrame:
    """Filled hours over valued hours per batch; a circuit counts only hours beyond its raw rows."""
    per_circuit = grid.groupBy(*KEYS, "circuit_type", "ingestion_source").agg(
        F.count("kwh").alias("_hours"), F.max("circuit_raw_rows").alias("_raw")
    )
    return (
        per_circuit.groupBy(*scope)
        .agg(
            F.sum(F.greatest(F.col("_hours") - F.col("_raw"), F.lit(0))).alias("interpolated"),
            F.sum("_hours").alias("valued"),
        )
        .withColumn("ratio", F.try_divide(F.col("interpolated"), F.col("valued")))
    )


def fill_issues(ratios: DataFrame, cfg: GateConfig) -> DataFrame:
    return ratios.filter(F.col("ratio") > cfg.max_fill_ratio).select(
        *BATCH,
        F.lit("high_interpolation_ratio").alias("issue_type"),
        F.lit("degraded").alias("severity"),
        F.concat(
            F.lit("Interpolated "), F.col("interpolated").cast("string"), F.lit("/"),
            F.col("valued").cast("string"), F.lit(" ("), fixed_text(F.col("ratio") * 100, 1),
            F.lit(f"%) exceeds threshold {cfg.max_fill_ratio:.0%}"),
        ).alias("description"),
    )


def batch_rollup(readings: DataFrame, batches: DataFrame, scope: Sequence[str] = BATCH) -> DataFrame:
    """Counts per status and the overall verdict; a batch without readings is quarantined."""
    s = F.col("data_quality_status")
    counts = readings.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(s == "pass").alias("pass_count"),
        F.count_if(s == "degraded").alias("degraded_count"),
        F.count_if(s == "quarantined").alias("quarantined_count"),
    )
    names = ("total_rows", "pass_count", "degraded_count", "quarantined_count")
    out = batches.join(counts, list(scope), "left").withColumns(
        {n: F.coalesce(n, F.lit(0)).cast("long") for n in names}
    )
    return out.withColumn(
        "overall_status",
        F.when(F.col("total_rows") == F.col("quarantined_count"), "quarantined")
        .when(F.col("total_rows") == F.col("pass_count"), "pass")
        .otherwise("degraded"),
    )


def gate_verdict(readings: DataFrame) -> DataFrame:
    """Per building: nothing usable stops the analysis, any degraded row degrades it."""
    s = F.col("data_quality_status")
    return (
        readings.groupBy("tenant_id", "building_id")
        .agg(
            F.count_if(s == "pass").alias("n_pass"),
            F.count_if(s == "degraded").alias("n_degraded"),
            F.count_if(s == "quarantined").alias("n_quarantined"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("n_pass") + F.col("n_degraded") == 0, "stop")
            .when(F.col("n_degraded") > 0, "degraded")
            .otherwise("pass"),
        )
    )


# --- whole gate ------------------------------------------------------------------------------
TASK_HOURS = 50_000


def place_cells(cells: DataFrame, series: Sequence[str]) -> tuple[DataFrame, int]:
    """Cells by circuit in tasks of about TASK_HOURS hours of the grid, and the number of tasks.

    The grid is many times as large as the cells that it is built from, so their bytes, by which adaptive execution deals, say little about a task's memory.
    """
    cells = store_table(cells, "cells")
    spans = cells.groupBy(*series).agg(((F.unix_seconds(F.max("hour")) - F.unix_seconds(F.min("hour"))) / 3600 + 1).alias("hours"), F.count(F.lit(1)).alias("n"))
    size = spans.agg(F.sum(F.greatest("hours", "n"))).first()[0] or 0
    tasks = max(1, math.ceil(size / TASK_HOURS))
    return cells.repartition(tasks, *KEYS), tasks


def quality_gate(
    raw: DataFrame,
    batches: DataFrame,
    bounds: DataFrame,
    batch_issues: DataFrame | None = None,
    cfg: GateConfig = GateConfig(),
) -> GateResult:
    """Runs every check over all batches.

    `raw`: KEYS, circuit_type, ingestion_source, ts, kwh (typed). `batches`: one row per batch.
    `batch_issues`: drift, missing-column and unmapped issues. Only drift touches every reading;
    batches with missing columns bring no readings.
    """
    raw = raw_stamps(raw)
    series = [*KEYS, "circuit_type", "ingestion_source"]
    # cells are few per circuit; placed by circuit once, they serve hours, windows and dropouts in place
    cells, tasks = place_cells(raw_cells(raw, series, cfg), series)
    grid = grid_of_sums(sums_of_cells(cells, series), series, cfg)
    scored = outlier_scores(grid, series, cfg)
    bounded = with_bounds(scored, bounds)
    rank = F.greatest(
        F.when(long_gap(cfg) | implausible(), F.lit(2)).otherwise(F.lit(0)),
        F.when(F.col("is_outlier"), F.lit(1)).otherwise(F.lit(0)),
    )
    readings = bounded.withColumn("data_quality_status", rank_status(rank))

    ratios = fill_ratio(grid)
    faults = sensor_faults(grid, cells, series, cfg)
    degrade = fill_issues(ratios, cfg)
    whole = degrade
    if batch_issues is not None:
        whole = degrade.unionByName(batch_issues.filter("issue_type = 'schema_drift'"))
    judged = apply_issues(readings, faults, KEYS, whole=whole, tasks=tasks)

    issues = (
        gap_issues(grid, series, cfg)
        .unionByName(outlier_issues(scored, series, cfg))
        .unionByName(bounds_issues(bounded, series))
        .unionByName(faults)
        .drop("circuit_type", "ingestion_source")
        .unionByName(degrade, allowMissingColumns=True)
    )
    if batch_issues is not None:
        issues = issues.unionByName(batch_issues, allowMissingColumns=True)

    readings_out = judged.select(
        "tenant_id", "building_id", "batch_id", "circuit_id", "circuit_type", "ts", "kwh",
        F.hour("ts").between(9, 18).alias("is_peak_hour"),
        "filled",
        "data_quality_status",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("ingestion_source").alias("source_system"),
        F.lit(NORMALIZATION_VERSION).alias("normalization_version"),
    )
    return GateResult(readings_out, issues, batch_rollup(readings_out, batches))
