"""Even shares of buildings for grouped functions.

A grouped function receives a whole group. To keep groups small whatever a building's size, rows
are keyed by (building, shard), and the building's model rows are copied to each of its shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.operators.skew import salted_join

KEYS = ["tenant_id", "building_id"]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions by `keys` into a fixed number of partitions.

    Groups that cost much processor time are small in bytes; without a fixed number adaptive
    execution would merge their partitions into a few long tasks.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def shard_counts(rows: DataFrame, shard_rows: int) -> DataFrame:
    """(keys, n_rows, shards) per building."""
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "shards", F.ceil(F.col("n_rows") / shard_rows).cast("int")
    )


def shard_rows(rows: DataFrame, counts: DataFrame, *by: str) -> DataFrame:
    """Adds `shard` from a hash of `by`; rows that agree in `by` stay together."""
    return salted_join(rows, counts.select(*KEYS, "shards"), KEYS).withColumn(
        "shard", F.pmod(F.xxhash64(*by), F.col("shards")).cast("int")
    ).drop("shards")


def copy_to_shards(models: DataFrame, counts: DataFrame) -> DataFrame:
    """Model rows once per shard of their building."""
    return models.join(counts.select(*KEYS, "shards"), KEYS).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    ).drop("shards")
