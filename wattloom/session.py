"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# settings that results depend on, or that plans of this package expect
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# bytes up to which a side may be broadcast on an estimate alone: the estimate follows file bytes, and sees neither compression nor the rows that explode adds
ESTIMATED = 128 << 10


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def configure(spark: SparkSession, measured: bool = True) -> SparkSession:
    """`measured`: sides beyond ESTIMATED are broadcast by the bytes that they were shuffled with, up to the session's threshold, and not by estimates of them."""
    for k, v in RUNTIME.items():
        spark.conf.set(k, v)
    if measured:
        planned, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
        most = spark.conf.get(planned)
        if spark.conf.get(adaptive, None) is None:
            spark.conf.set(adaptive, most)
        spark.conf.set(planned, str(min(_bytes(most), ESTIMATED)))
    return spark


def local_session(name: str, cores: str = "8", memory: str = "12g", shared: str | None = None) -> SparkSession:
    """Session for tests and benches on one machine; `shared` names the folder for checkpoints and intermediate tables."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    )
    if shared:
        b = b.config("spark.checkpoint.dir", shared).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for k, v in RUNTIME.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A session on one machine that names none, such as a trial, gets one of its own, once."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wattloom-shared-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes `df` to the cluster's checkpoint folder and reads it back, so that lost executors do not replay the jobs behind it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store_table(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it back: a lineage cut whose columns can be pruned later."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
