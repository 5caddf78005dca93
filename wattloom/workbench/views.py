"""The test tables seen as meters, buildings, findings and labels. Mirrored in `oracles.py`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.session import configure

TYPE_OF = {"click": "hvac", "view": "plug_load", "purchase": "main_feed", "signup": "lighting", "error": "unlisted"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Zone-free timestamps at the edge, as the comparison engine prints them."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if f.dataType.typeName() == "timestamp"
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def text(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def circuit_type(c="event_type"):
    expr = None
    for k, v in TYPE_OF.items():
        expr = F.when(F.col(c) == k, v) if expr is None else expr.when(F.col(c) == k, v)
    return expr


def raw_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings: fifty users make a building, one circuit per event type."""
    e = table(spark, sf_dir, "events")
    b = F.concat(F.lit("b"), F.floor(F.col("user_id") / 50).cast("string"))
    t = F.concat(F.lit("t"), F.floor(F.col("user_id") / 100).cast("string"))
    return e.select(
        t.alias("tenant_id"),
        b.alias("building_id"),
        F.concat(F.lit("u-"), b).alias("batch_id"),
        F.concat_ws("-", b, "event_type").alias("circuit_id"),
        circuit_type().alias("circuit_type"),
        F.lit("csv_upload").alias("ingestion_source"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("kwh"),
    )


def user_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse raw readings: one circuit per user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("t"), F.floor(F.col("user_id") / 100).cast("string")).alias("tenant_id"),
        F.concat(F.lit("b"), F.floor(F.col("user_id") / 50).cast("string")).alias("building_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("circuit_id"),
        F.when(F.col("user_id") % 2 == 0, "smart_meter_api").otherwise("csv_upload").alias("ingestion_source"),
        "event_type",
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("kwh"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed circuit-hours with a status by size of the hourly sum."""
    from wattloom.operators.resample import hourly_sums

    h = hourly_sums(raw_meters(spark, sf_dir), ["tenant_id", "building_id", "circuit_id", "circuit_type"])
    return h.select(
        "tenant_id", "building_id", "circuit_id", "circuit_type", "ts", "kwh",
        F.when(F.col("kwh") > 250, "quarantined").when(F.col("kwh") > 150, "degraded").otherwise("pass").alias("data_quality_status"),
    )


def circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_meters(spark, sf_dir).select(
        "tenant_id", "building_id", "circuit_id", "circuit_type", F.col("circuit_id").alias("label")
    ).distinct()


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building dimension from supplier rows: geography and tariffs follow the supplier's numbers."""
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("t"), F.floor(n / 2).cast("string")).alias("tenant_id"),
        F.concat(F.lit("b"), n.cast("string")).alias("building_id"),
        F.col("s_name").alias("name"),
        F.when(n % 3 == 0, "office").when(n % 3 == 1, "retail").otherwise("hotel").alias("building_type"),
        F.when(n % 2 == 0, "warm").otherwise("composite").alias("climate_zone"),
        (n % 4 == 3).alias("cold_start"),
        F.when(n % 5 != 4, F.lit(20.0) + (n % 7) * 5.0).alias("declared_unoccupied_baseline"),
        F.when(
            n % 6 != 5,
            F.struct(
                F.array(*[F.lit(d) for d in (1, 2, 3, 4, 5)]).alias("days"),
                F.lit("08:00").alias("start"),
                F.lit("18:00").alias("end"),
            ),
        ).alias("occupancy_schedule"),
        F.when(n % 3 != 2, F.lit(9.0) + (n % 4) * 0.5).alias("peak_rate"),
        F.when(n % 3 != 1, F.lit(5.0) + (n % 5) * 0.25).alias("offpeak_rate"),
        F.when(n % 4 != 2, F.lit(4000.0) + (n % 10) * 3000.0).alias("rooftop_area_sqm"),
        F.when(n % 7 != 6, F.col("s_nationkey") * 2.0 - 10.0).alias("latitude"),
        F.when(n % 7 != 6, F.lit(77.0)).alias("longitude"),
        (F.lit("2023-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(n.cast("int") % 50)).alias("onboarded_at"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings from orders: five hundred customers make a building."""
    o = table(spark, sf_dir, "orders")
    c = F.col("o_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPE_OF]), (c % 5 + 1).cast("int"))
    rule = (
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "hvac_after_hours_v3")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "weekend_vampire_load_v1")
        .when(F.col("o_orderpriority") == "5-LOW", "other_rule_v1")
    )
    b = F.concat(F.lit("b"), F.floor(c / 500).cast("string"))
    return o.select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("finding_id"),
        F.concat(F.lit("t"), F.floor(c / 1000).cast("string")).alias("tenant_id"),
        b.alias("building_id"),
        F.concat_ws("-", b, kind).alias("circuit_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "ml_ensemble").otherwise("domain_rule").alias("layer_origin"),
        rule.alias("rule_id"),
        F.col("o_orderdate").cast("timestamp").alias("detected_at"),
        F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "dismissed").otherwise("open").alias("status"),
        F.when(F.col("o_orderkey") % 4 != 0, F.round(F.col("o_totalprice") / 600000, 8)).alias("confidence"),
        F.round(F.col("o_totalprice") / 100000 - 2.5, 7).alias("anomaly_score"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback labels from line items on the findings above."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.concat_ws("-", F.lit("l"), *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("feedback_id"),
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("finding_id"),
        F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "dismissed").otherwise("noted").alias("action"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )
