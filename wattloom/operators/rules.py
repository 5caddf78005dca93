"""Rule engine: every rule over every reading in one scan.

All predicates are evaluated side by side in one projection and the fired ones are unpacked with
`inline`, so readings are read once however many rules there are, and no nested-loop join occurs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.scalars import stable_id
from wattloom.operators.scope import building_context
from wattloom.sources.rules import SHIPPED_RULES, Rule, install_functions

CONTEXT = ("ts", "kwh", "circuit_type", "building")


def applies(rule: Rule) -> Column:
    """Every applies_to entry equals the context column of its name; no entries match all."""
    out = F.lit(True)
    for name, value in rule.applies_to.items():
        out = out & F.col(name).eqNullSafe(F.lit(value))
    return out


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Expressions that are resolved inside give null where ANSI mode would raise: division by zero, bad casts, places beyond an array.

    The mode belongs to an expression from its resolution on, so one failing row neither ends the job nor changes other queries of the session.
    """
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def holds(rule: Rule) -> Column:
    """The rule's condition; a null or failing one counts as not met. To be resolved inside `lenient`."""
    return F.coalesce(F.expr(f"({rule.condition})"), F.lit(False))


def check_columns(df: DataFrame, rules: Sequence[Rule]) -> None:
    """Conditions may use only the context columns: they must resolve against a frame of nothing else."""
    context = df.select(*[c for c in CONTEXT if c in df.columns]).limit(0)
    with lenient(df.sparkSession):
        for rule in rules:
            context.select(F.expr(f"({rule.condition})").cast("boolean")).schema  # noqa: B018


def fired(readings: DataFrame, buildings: DataFrame, rules: Sequence[Rule] = SHIPPED_RULES) -> DataFrame:
    """One row per (reading, rule that fired), for readings that are not quarantined and have a stamp."""
    install_functions(readings.sparkSession)
    usable = readings.filter((F.col("data_quality_status") != "quarantined") & F.col("ts").isNotNull())
    ctx = building_context(usable, buildings)
    check_columns(ctx, rules)
    hits = F.array(
        *[
            F.when(
                applies(r) & holds(r),
                F.struct(
                    F.lit(r.rule_id).alias("rule_id"),
                    F.lit(r.version).alias("rule_version"),
                    F.lit(r.citation).alias("citation"),
                    F.lit(r.severity).alias("severity"),
                ),
            )
            for r in rules
        ]
    )
    # SQL functions may stand in a projection but not in a generator, hence the two steps
    with lenient(readings.sparkSession):
        met = ctx.select("tenant_id", "building_id", "circuit_id", "ts", "kwh", hits.alias("_hits"))
    return (
        met.withColumn("_hits", F.filter("_hits", lambda h: h.isNotNull()))
        .filter(F.size("_hits") > 0)
        .select("tenant_id", "building_id", "circuit_id", "ts", "kwh", F.inline("_hits"))
    )


def rule_findings(fires: DataFrame) -> DataFrame:
    """One open finding per fire, with a zero-width evidence window and the citation in its bundle."""
    fid = stable_id("", F.lit("domain_rule"), "tenant_id", "circuit_id", "ts", "rule_id")
    bundle = F.struct(
        F.col("finding_id"),
        F.array(F.lit("domain_rule")).alias("contributing_layers"),
        F.array().cast("array<struct<feature:string,shap_value:double,plain_language:string>>").alias("top_features"),
        F.array(
            F.struct(F.col("rule_id"), F.col("rule_version").alias("version"), F.col("citation"))
        ).alias("rule_citations"),
        F.lit(None).cast("struct<lower:double,upper:double,method:string>").alias("confidence_band"),
        F.struct(F.col("ts").alias("start"), F.col("ts").alias("end")).alias("evidence_window"),
    )
    return fires.withColumn("finding_id", fid).select(
        "finding_id", "tenant_id", "building_id", "circuit_id",
        F.lit("domain_rule").alias("layer_origin"),
        F.col("ts").alias("detected_at"),
        F.col("ts").alias("evidence_start"),
        F.col("ts").alias("evidence_end"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit("open").alias("status"),
        F.lit(None).cast("double").alias("anomaly_score"),
        bundle.alias("bundle"),
    )


def fire_maps(fires: DataFrame) -> DataFrame:
    """Per circuit-hour: map of rule id to true. Bounded by the number of rules."""
    ids = F.array_sort(F.collect_set("rule_id"))
    return fires.groupBy("tenant_id", "circuit_id", "ts").agg(
        F.map_from_arrays(ids, F.transform(ids, lambda _: F.lit(True))).alias("rule_fire_indicators")
    )
