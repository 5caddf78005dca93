"""Raw meter inputs: CSV files, wide tables, nested push payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.sources.presets import SourcePreset, resolve_columns

BOM = "﻿"
PUSH_SCHEMA = "readings array<struct<meter_id:string,timestamp:string,kwh:double,circuit_type:string>>"


def read_meter_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column text. Files are split by Spark, so any size streams through."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return strip_bom(df)


def strip_bom(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(BOM, "") for c in df.columns])


def parse_csv_lines(lines: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Header-less CSV lines in a text column to all-text columns; short lines give nulls."""
    schema = ", ".join(f"`{n}` string" for n in names)
    rest = [c for c in lines.columns if c != column]
    return lines.select(*rest, F.from_csv(F.ltrim(F.replace(F.col(column), F.lit(BOM), F.lit(""))), schema).alias("_r")).select(
        *rest, "_r.*"
    )


def read_meters(spark: SparkSession, path: str, source: SourcePreset) -> DataFrame:
    return resolve_columns(read_meter_csv(spark, path), source)


def wide_to_long(df: DataFrame, stamp: str = "timestamp", meters: list[str] | None = None) -> DataFrame:
    """One column per meter to (meter_id, timestamp, kwh) rows; empty cells bring no row."""
    cols = meters or [c for c in df.columns if c != stamp]
    long = df.select(stamp, *cols).unpivot([stamp], cols, "meter_id", "kwh")
    value = F.trim(F.col("kwh").cast("string"))
    return long.filter(F.col(stamp).isNotNull() & F.col("kwh").isNotNull() & (value != ""))


def push_rows(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Nested push payloads to one row per reading; works on batches and streams alike."""
    rest = [c for c in payloads.columns if c != column]
    return payloads.select(*rest, F.from_json(F.col(column).cast("string"), PUSH_SCHEMA).alias("_p")).select(
        *rest, F.inline("_p.readings")
    )


def push_payload(*fields: Column) -> Column:
    """Payload text holding one reading; the inverse of `push_rows` for tests and replays."""
    return F.to_json(F.struct(F.array(F.struct(*fields)).alias("readings")))
