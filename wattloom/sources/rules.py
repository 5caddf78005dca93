"""Versioned domain rules.

A rule's condition is a Spark SQL predicate over `ts`, `kwh`, `circuit_type`, `building`
(a struct) and the SQL function `within_sched(schedule, ts)`. Spark parses and types it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    version: int
    condition: str
    citation: str
    severity: str = "medium"
    applies_to: dict = field(default_factory=dict)


# fixed values: shipped rules with their thresholds and citations
SHIPPED_RULES = (
    Rule(
        "hvac_after_hours_v3", 3,
        "kwh > building.declared_unoccupied_baseline * 1.4 AND NOT within_sched(building.occupancy_schedule, ts)",
        "ASHRAE Guideline 36 — HVAC scheduling FDD pattern", "medium", {"circuit_type": "hvac"},
    ),
    Rule(
        "scheduling_violation_v1", 1,
        "kwh > building.declared_unoccupied_baseline * 1.5 AND NOT within_sched(building.occupancy_schedule, ts)",
        "ASHRAE Guideline 36 — General scheduling violation", "medium", {"circuit_type": "main_feed"},
    ),
    Rule(
        "weekend_vampire_load_v1", 1,
        "kwh > building.declared_unoccupied_baseline * 1.2 AND NOT within_sched(building.occupancy_schedule, ts)"
        " AND weekday(ts) + 1 IN (6, 7)",
        "ASHRAE Guideline 36 — Weekend vampire load pattern", "low", {"circuit_type": "plug_load"},
    ),
)


def rule_table(spark: SparkSession, rules=SHIPPED_RULES) -> DataFrame:
    rows = [(r.rule_id, r.version, dict(r.applies_to), r.severity, r.condition, r.citation) for r in rules]
    return spark.createDataFrame(
        rows,
        "rule_id string, version int, applies_to map<string,string>, severity string, condition string, citation string",
    )


def check_versions(candidates: DataFrame, registered: DataFrame) -> DataFrame:
    """Adds `registered_version` and `accepted`; a candidate below the registered version is refused."""
    latest = registered.groupBy("rule_id").agg(F.max("version").alias("registered_version"))
    return candidates.join(latest, "rule_id", "left").withColumn(
        "accepted", F.coalesce(F.col("version") >= F.col("registered_version"), F.lit(True))
    )


def require_versions(candidates: DataFrame, registered: DataFrame) -> DataFrame:
    """Like `check_versions`, but a refused rule fails the job."""
    c = check_versions(candidates, registered)
    message = F.concat(F.lit("rule older than registered: "), F.col("rule_id"))
    return c.filter(F.assert_true("accepted", message).isNull()).drop("accepted")


def install_functions(spark: SparkSession) -> None:
    """Registers `within_sched` for rule conditions: ISO weekday listed, clock time inside, ends included."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION within_sched("
        "s STRUCT<days: ARRAY<INT>, start: STRING, `end`: STRING>, t TIMESTAMP) RETURNS BOOLEAN RETURN "
        "coalesce(array_contains(s.days, weekday(t) + 1) AND date_format(t, 'HH:mm:ss.SSSSSS') BETWEEN "
        "concat(coalesce(s.start, '00:00'), ':00.000000') AND concat(coalesce(s.`end`, '23:59'), ':00.000000'), false)"
    )


def floor_div(a: Column, b: Column) -> Column:
    """Floor division, for conditions that need it; null for a zero divisor."""
    return F.floor(F.try_divide(a, b))


def floor_mod(a: Column, b: Column) -> Column:
    return a - b * floor_div(a, b)
