"""Feature assembly, vectors, scaling, chronological split and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import BASE_FEATURES, DAY_TYPE_CODES, FEATURE_SCHEMA_VERSION, FeatureConfig
from wattloom.functions.scalars import coded, flag, iso_weekday
from wattloom.operators.ranking import placed_rows, position_in_group
from wattloom.operators.skew import salted_join

ROW = ("tenant_id", "circuit_id", "ts")


def rolling_features(readings: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Trailing baseline, hour flags, weekend floor and efficiency per circuit-hour.

    The trailing range frame and the whole-circuit averages share one partitioning, so a circuit
    is shuffled once; its rows are hours, so its size is bounded by the window's length.
    """
    circuit = Window.partitionBy("tenant_id", "circuit_id")
    trailing = circuit.orderBy(F.unix_seconds("ts")).rangeBetween(-cfg.window_hours * 3600 + 1, 0)
    hour, day = F.hour("ts"), iso_weekday("ts")
    open_hours = (hour >= cfg.open_hour) & (hour < cfg.close_hour)
    weekend = day >= 6
    kwh = F.col("kwh")

    # settled at nine digits: the order of summation must not show in later comparisons
    baseline = F.round(F.avg(F.coalesce(kwh, F.lit(0.0))).over(trailing), 9)
    weekend_after = F.avg(F.when(weekend & ~open_hours, kwh)).over(circuit)
    weekday_after = F.coalesce(F.avg(F.when(~weekend & ~open_hours, kwh)).over(circuit), F.lit(1.0))
    return readings.withColumns(
        {
            "rolling_baseline_kwh": baseline,
            "peak_offpeak_split": F.when(
                kwh.isNotNull() & (kwh != 0), hour.between(cfg.peak_first, cfg.peak_last).cast("double")
            ),
            "after_hours_kwh_ratio": F.when(kwh.isNotNull(), (~(open_hours & ~weekend)).cast("double")),
            "weekend_floor_load": F.when(weekend & (weekday_after != 0), weekend_after / weekday_after),
        }
    ).withColumn("rolling_efficiency_ratio", F.when(F.col("rolling_baseline_kwh") > 0, kwh / F.col("rolling_baseline_kwh")))


def assemble(readings: DataFrame, residuals: DataFrame | None, fires: DataFrame | None, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The versioned feature set: rolling features with residual fields and rule fires by exact hour."""
    out = rolling_features(readings, cfg)
    if residuals is not None:
        out = out.join(
            residuals.select(*ROW, F.col("residual_magnitude").alias("stl_residual_magnitude"), "day_type", "low_data_quality"),
            list(ROW), "left",
        )
    else:
        out = out.withColumns({"stl_residual_magnitude": F.lit(None).cast("double"), "day_type": F.lit(None).cast("string"), "low_data_quality": F.lit(None).cast("boolean")})
    if fires is not None:
        out = out.join(fires.select(*ROW, "rule_fire_indicators"), list(ROW), "left")
    else:
        out = out.withColumn("rule_fire_indicators", F.lit(None).cast("map<string,boolean>"))
    return out.select(
        "tenant_id", "building_id", "circuit_id", "ts", "kwh",
        F.lit(FEATURE_SCHEMA_VERSION).alias("feature_schema_version"),
        "rolling_baseline_kwh", "peak_offpeak_split", "after_hours_kwh_ratio", "weekend_floor_load",
        "rolling_efficiency_ratio", "stl_residual_magnitude",
        F.coalesce("day_type", F.lit("business_day")).alias("day_type"),
        F.coalesce("rule_fire_indicators", F.create_map().cast("map<string,boolean>")).alias("rule_fire_indicators"),
        F.coalesce("low_data_quality", F.lit(False)).alias("low_data_quality"),
    )


def require_schema_version(features: DataFrame) -> DataFrame:
    ok = F.col("feature_schema_version") == FEATURE_SCHEMA_VERSION
    return features.filter(F.assert_true(ok, F.lit("feature_schema_version mismatch")).isNull())


def rule_ids(features: DataFrame) -> DataFrame:
    """Sorted rule ids seen per building: the tail of its vector layout."""
    return (
        features.select("tenant_id", "building_id", F.explode(F.map_keys("rule_fire_indicators")).alias("rule_id"))
        .groupBy("tenant_id", "building_id")
        .agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    )


def with_rule_ids(features: DataFrame) -> DataFrame:
    return salted_join(features, rule_ids(features), ["tenant_id", "building_id"], "left").withColumn(
        "rule_ids", F.coalesce("rule_ids", F.array().cast("array<string>"))
    )


def base_vector() -> list[Column]:
    parts = [F.coalesce(c, F.lit(0.0)) for c in BASE_FEATURES[:-1]]
    return [*parts, coded("day_type", DAY_TYPE_CODES).cast("double")]


def vectorize(features: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """Adds `vector`: base features then rule flags, nulls as 0. Without `ids` each row must carry
    its layout in `rule_ids`."""
    if ids is None:
        flags = F.transform(
            "rule_ids", lambda r: F.coalesce(F.try_element_at("rule_fire_indicators", r), F.lit(False)).cast("double")
        )
    else:
        flags = F.array(*[flag("rule_fire_indicators", i).cast("double") for i in ids]) if ids else F.array().cast("array<double>")
    return features.withColumn("vector", F.concat(F.array(*base_vector()), flags))


def feature_names(ids: Column) -> Column:
    base = F.array(*[F.lit(n) for n in BASE_FEATURES])
    return F.concat(base, F.transform(ids, lambda r: F.concat(F.lit("rule_fire_"), r)))


# --- scaling -------------------------------------------------------------------------------------
def fit_scaler(vectors: DataFrame, keys: Sequence[str] = ("tenant_id", "building_id")) -> DataFrame:
    """Mean and population deviation per building and vector position; a constant position scales by 1."""
    long = vectors.select(*keys, F.posexplode("vector").alias("pos", "x"))
    return long.groupBy(*keys, "pos").agg(
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("_sd"),
        F.count(F.lit(1)).alias("n"),
    ).select(*keys, "pos", "mean", F.when(F.col("_sd") < 1e-12, 1.0).otherwise(F.col("_sd")).alias("scale"), "n")


def scaler_arrays(scaler: DataFrame, keys: Sequence[str] = ("tenant_id", "building_id")) -> DataFrame:
    """One row per building with `means` and `scales`, bounded by the vector length."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "mean", "scale")))
    return scaler.groupBy(*keys).agg(pairs.alias("_p")).select(
        *keys, F.transform("_p", lambda p: p["mean"]).alias("means"), F.transform("_p", lambda p: p["scale"]).alias("scales")
    )


def standardized() -> Column:
    return F.zip_with(F.zip_with("vector", "means", lambda x, m: x - m), "scales", lambda d, s: d / s)


# --- split and windows ---------------------------------------------------------------------------
def chronological_split(features: DataFrame, train: float = 0.7, validation: float = 0.15, keys: Sequence[str] = ("tenant_id", "building_id")) -> DataFrame:
    """Adds `split` by position in time within each building (or over all rows with no keys)."""
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("fractions must lie in (0, 1) and leave a test share")
    if keys:
        placed = position_in_group(features, keys, "ts", ["circuit_id"])
    else:
        # one group in all: ranges of rows, with the sums of the ranges before
        placed = placed_rows(features, [], [F.col("ts"), F.col("circuit_id")]).withColumn("position", F.col("position") + 1)
    first = F.floor(F.col("group_rows") * train)
    second = first + F.floor(F.col("group_rows") * validation)
    return placed.withColumn(
        "split",
        F.when(F.col("position") <= first, "train").when(F.col("position") <= second, "validation").otherwise("test"),
    )


def sliding_windows(vectors: DataFrame, length: int = 24, value: str = "vector") -> DataFrame:
    """Flattened runs of `length` consecutive rows of a circuit, on the last row of each run."""
    w = Window.partitionBy("tenant_id", "circuit_id").orderBy("ts")
    runs = F.collect_list(value).over(w.rowsBetween(-(length - 1), 0))
    return (
        vectors.withColumns({"_n": F.row_number().over(w), "_run": runs, "window_start": F.first("ts").over(w.rowsBetween(-(length - 1), 0))})
        .filter(F.col("_n") >= length)
        .withColumn("window", F.flatten("_run"))
        .drop("_n", "_run")
    )
