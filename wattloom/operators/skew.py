"""Equi-joins of a large side with hot keys to a side with few rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(large: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """`large.join(small, keys, how)` with every key spread over `salts` partitions.

    The large side draws its salt from its own row, so a retry draws the same one; the small side is
    copied once per salt. For inner, left, left_semi and left_anti joins the result is the same as
    without salt, since each large row still meets exactly one copy.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salting does not preserve a {how} join")
    # sums and means may differ in their last bits on a retry, so they do not choose the salt
    plain = {"string", "long", "integer", "short", "byte", "date", "timestamp", "timestamp_ntz", "boolean", "binary"}
    steady = [f.name for f in large.schema.fields if f.dataType.typeName() in plain]
    if set(steady) <= set(keys):
        steady += [f.name for f in large.schema.fields if f.dataType.typeName() in ("double", "float", "decimal")]
    spread = large.withColumn("_salt", F.pmod(F.xxhash64(*steady), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
