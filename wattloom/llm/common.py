"""Tables, intermediate results and size-checked joins that the operators share."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators.skew import salted_join
from wattloom.session import configure, shared_path

# rows of a small side that may be copied to every executor; beyond it the join shuffles
BROADCAST_ROWS = 500_000

# the white space of all word definitions here, as the inside of a regex class
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Long texts travel to Python in small batches, so that a worker's memory stays bounded."""
    configure(spark, measured=False)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    # files of a shuffle go with the job that made them, not when the driver happens to collect its garbage; a job that asks for them again makes them again
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: list[list[str]] = []  # paths of the tables of each `recorded` block that is open


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as a table in the cluster's shared folder and reads it back: a lost executor replays nothing before it."""
    path = shared_path(df.sparkSession, name)
    for paths in _WRITTEN:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def recorded():
    """The paths of the tables that operators write inside of the block."""
    paths: list[str] = []
    _WRITTEN.append(paths)
    try:
        yield paths
    finally:
        _WRITTEN[:] = [p for p in _WRITTEN if p is not paths]


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that have had their last reader."""
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


REST = "columns_of_the_input"


def packed(docs: DataFrame, needed: Sequence[str]) -> DataFrame:
    """The needed columns, and all others as one struct, so that no name of theirs meets a working column of an operator."""
    others = [c for c in docs.columns if c not in needed]
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias(REST)] if others else []
    return docs.select(*needed, *rest)


def unpacked(columns: Sequence[str], needed: Sequence[str]) -> list[Column]:
    """The columns of the input again, in the order in which they are named."""
    return [F.col(f"`{c}`") if c in needed else F.col(f"{REST}.`{c}`").alias(c) for c in columns]


def keeping(docs: DataFrame, needed: Sequence[str], work: Callable[[DataFrame], DataFrame], dropped: Sequence[str] = ()) -> DataFrame:
    """`work` on the needed columns alone; its new columns stand behind the input's, of which those named like a new one or like one of `dropped` go."""
    out = work(packed(docs, needed))
    made = [c for c in out.columns if c not in needed and c != REST]
    stay = [c for c in docs.columns if c not in made and c not in dropped]
    return out.select(*unpacked(stay, needed), *made)


def small_join(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a settled side that is usually small: copied to executors only if its counted rows allow it, salted otherwise."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return large.join(F.broadcast(small), keys, how)
    return salted_join(large, small, keys, how)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; each word and the space behind it become one character, so no array of words is built."""
    ones = F.regexp_replace(F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS)), rf"[^{SPACE}]++[{SPACE}]*+", ".")
    return F.length(ones).cast("long")
