"""Plausibility bounds as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.config import BUILT_IN_BOUNDS, DEFAULT_BOUNDS

SCHEMA = "circuit_type string, min_kwh double, max_kwh double"


def built_in_bounds(spark: SparkSession) -> DataFrame:
    rows = [(k, lo, hi) for k, (lo, hi) in BUILT_IN_BOUNDS.items()]
    return spark.createDataFrame([*rows, ("__default__", *DEFAULT_BOUNDS)], SCHEMA)


def active_bounds(table: DataFrame) -> DataFrame:
    """Active rows of a bounds table; without any active row the built-in bounds apply."""
    active = table.filter("is_active").select("circuit_type", "min_kwh", "max_kwh")
    fallback = built_in_bounds(table.sparkSession)
    n_active = active.agg(F.count(F.lit(1))).scalar()
    return active.unionByName(fallback.filter(n_active == 0))


def bounds_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Bounds document {circuit_type_bounds: {type: {min_kwh, max_kwh}}, default_bounds: {...}}."""
    entry = "struct<min_kwh:double,max_kwh:double>"
    doc = spark.read.schema(
        f"circuit_type_bounds map<string,{entry}>, default_bounds {entry}"
    ).json(path, multiLine=True)
    by_type = doc.select(F.explode("circuit_type_bounds").alias("circuit_type", "b"))
    default = doc.select(F.lit("__default__").alias("circuit_type"), F.col("default_bounds").alias("b"))
    return by_type.unionByName(default).select("circuit_type", "b.min_kwh", "b.max_kwh")
