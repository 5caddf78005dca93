"""Upserts by key.

The incoming side is reduced to its last row per key by an aggregate with partial results, so
re-deliveries of one key never pile up in a task; the join key is the table's unique key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READING_KEY = ("tenant_id", "circuit_id", "ts")
READING_VALUES = ("kwh", "data_quality_status")
CALENDAR_KEY = ("tenant_id", "building_id", "date")


def last_per_key(incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in incoming.columns if c not in keys]
    return (
        incoming.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def upsert(
    current: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str] = READING_KEY,
    update: Sequence[str] | None = None,
    order: Sequence[str] = ("batch_seq",),
) -> DataFrame:
    """Merged table: new keys are added, known keys take `update` columns (default: all) from the
    last incoming row and keep the rest."""
    update = [c for c in current.columns if c not in keys] if update is None else list(update)
    new = last_per_key(incoming, keys, order).withColumn("_new", F.lit(True))
    old = current.withColumn("_old", F.lit(True))
    joined = old.alias("o").join(new.alias("n"), list(keys), "full_outer")
    cols = []
    for c in current.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in update:
            cols.append(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("_old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return joined.select(*cols)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def upsert_files(
    path: str,
    incoming: DataFrame,
    keys: Sequence[str] = READING_KEY,
    update: Sequence[str] | None = READING_VALUES,
    order: Sequence[str] = ("batch_seq",),
    parts: Sequence[str] = ("tenant_id", "date"),
) -> None:
    """Merges into a partitioned parquet table, rewriting only the partitions that receive rows.

    The touched partitions are found by joining partition columns, which prunes the scan. Each partition is
    replaced as a whole when the job commits; a failure during the commit itself can leave some replaced and
    some not, and running the same merge again completes it.
    """
    spark = incoming.sparkSession
    writer_rows = incoming
    if path_exists(spark, path):
        current = spark.read.parquet(path)
        touched = incoming.select(*parts).distinct()
        writer_rows = upsert(current.join(touched, list(parts), "left_semi"), incoming, keys, update, order)
    else:
        writer_rows = last_per_key(incoming, keys, order).drop(*[c for c in order if c not in keys])
    (
        writer_rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )


def append_files(df: DataFrame, path: str, parts: Sequence[str] = ("tenant_id",)) -> None:
    """Appends to the parts' folders. A part's rows are brought together first, so that files grow with the rows and the parts, not with parts times tasks; a large part stays in several tasks."""
    df.hint("rebalance", *parts).write.mode("append").partitionBy(*parts).parquet(path)
