"""Named meter sources: column aliases, expected columns, required columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.scalars import name_key


@dataclass(frozen=True)
class SourcePreset:
    circuit_id: tuple
    ts: tuple
    kwh: tuple
    circuit_type: tuple
    expected: tuple
    required: tuple = ("meter_id", "timestamp", "kwh")
    minutes: int = 60

    def canonical(self, raw_name: str) -> str | None:
        """Canonical column for a raw name; groups are tried in declaration order."""
        wanted = raw_name.strip().lower()
        for target in ("circuit_id", "ts", "kwh", "circuit_type"):
            if wanted in {a.lower() for a in getattr(self, target)}:
                return target
        return None


# fixed values: alias lists of the built-in sources
PRESETS = {
    "default": SourcePreset(
        circuit_id=("meter_id", "meterId", "device_id", "sensor_id", "circuit_id"),
        ts=("timestamp", "ts", "time", "datetime", "reading_time"),
        kwh=("kwh", "kWh", "energy_kwh", "consumption", "reading"),
        circuit_type=("circuit_type", "circuitType", "type", "meter_type", "device_type"),
        expected=("meter_id", "timestamp", "kwh", "circuit_type"),
    ),
    "combed": SourcePreset(
        circuit_id=("meter_id", "meterId", "device_id", "sensor_id", "circuit_id", "panel"),
        ts=("timestamp", "ts", "time", "datetime", "reading_time", "Date & Time"),
        kwh=("kwh", "kWh", "energy_kwh", "consumption", "reading", "Power (kW)", "power_kw"),
        circuit_type=("circuit_type", "circuitType", "type", "meter_type", "device_type"),
        expected=("meter_id", "timestamp", "kwh"),
    ),
    "bdg2": SourcePreset(
        circuit_id=("meter_id", "building_id", "meter", "circuit_id"),
        ts=("timestamp", "ts", "time", "datetime"),
        kwh=("kwh", "meter_reading", "reading"),
        circuit_type=("circuit_type", "meter", "meter_type"),
        expected=("meter_id", "timestamp", "kwh"),
    ),
}


def preset(source_id: str) -> SourcePreset:
    """Preset by id; unknown ids use the default one."""
    return PRESETS.get(source_id, PRESETS["default"])


def resolve_columns(df: DataFrame, source: SourcePreset) -> DataFrame:
    """Renames raw columns to canonical ones; of two that claim one name the later one stays."""
    target = {c: source.canonical(c) or c for c in df.columns}
    last = {t: c for c, t in target.items()}
    return df.select(*[F.col(f"`{c}`").alias(t) for t, c in last.items()])


def alias_table(spark: SparkSession) -> DataFrame:
    """Preset aliases as rows (source_id, priority, canonical, alias), for many sources in one job."""
    rows = [
        (sid, i, target, alias.lower())
        for sid, p in PRESETS.items()
        for i, target in enumerate(("circuit_id", "ts", "kwh", "circuit_type"))
        for alias in dict.fromkeys(a.lower() for a in getattr(p, target))
    ]
    return spark.createDataFrame(rows, "source_id string, priority int, canonical string, alias string")


def expectation_table(spark: SparkSession) -> DataFrame:
    rows = [(sid, list(p.expected), list(p.required)) for sid, p in PRESETS.items()]
    return spark.createDataFrame(
        rows, "source_id string, expected array<string>, required array<string>"
    )


def with_preset(manifests: DataFrame, table: DataFrame, default: str = "default") -> DataFrame:
    """Joins each batch to its source's preset row, falling back to the default preset."""
    known = [r for r in PRESETS]
    key = F.when(F.col("source_id").isin(*known), F.col("source_id")).otherwise(F.lit(default))
    return manifests.withColumn("_preset", key).join(
        table.withColumnRenamed("source_id", "_preset"), "_preset", "left"
    )


def resolve_manifest(manifests: DataFrame, aliases: DataFrame) -> DataFrame:
    """Canonical column of every (batch, raw column) pair; the later raw column wins a conflict."""
    cols = manifests.select("batch_id", "source_id", F.posexplode("columns").alias("pos", "raw_column"))
    hit = with_preset(cols, aliases.filter(F.lit(True)))
    match = hit.filter(name_key("raw_column") == F.col("alias"))
    best = match.groupBy("batch_id", "source_id", "pos", "raw_column").agg(
        F.min_by("canonical", "priority").alias("canonical")
    )
    mapped = cols.join(best, ["batch_id", "source_id", "pos", "raw_column"], "left").withColumn(
        "column", F.coalesce("canonical", "raw_column")
    )
    return mapped.groupBy("batch_id", "source_id", "column").agg(
        F.max_by("raw_column", "pos").alias("raw_column")
    )
