"""Positions and quantiles of groups of any size.

A plain window over a building puts all of its rows in one task. Here positions come from counts
per time stamp, and quantiles from counting around an approximate one, so no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.operators.skew import salted_join
from wattloom.session import store_table


def position_in_group(df: DataFrame, keys: Sequence[str], coarse: str, ties: Sequence[str]) -> DataFrame:
    """Adds 1-based `position` by (coarse, ties) within keys, and `group_rows`.

    Rows are counted per value of `coarse` with partial sums; only those counts are accumulated in
    order. Inside one value the rows are numbered by `ties`.
    """
    keys = list(keys)
    per_value = df.groupBy(*keys, coarse).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*keys)
    before = group.orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_value.select(
        *keys, coarse,
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(group).alias("group_rows"),
    )
    inner = Window.partitionBy(*keys, coarse).orderBy(*ties)
    return (
        df.withColumn("_inner", F.row_number().over(inner))
        .join(offsets, [*keys, coarse])
        .withColumn("position", F.col("_before") + F.col("_inner"))
        .drop("_inner", "_before")
    )


def prefix_sums(counts: DataFrame, at: str, n: str, out: str) -> DataFrame:
    """Sum of `n` over the rows of the same `_g` with a smaller `at` (a non-negative integer), for every row.

    A tree of partial sums stands in for a running window: every row adds to one node of each level (`at` shifted right by the level), and
    reads the nodes left of its own path. So a long group needs no task that sees all of it; `at` is unique within `_g`.
    """
    top = counts.agg(F.max(at)).first()[0]
    levels = F.sequence(F.lit(0), F.lit(max(0, int(top or 0).bit_length() - 1)))
    node = F.expr(f"shiftright(`{at}`, _level)")
    sums = counts.select("_g", n, at, F.explode(levels).alias("_level")).groupBy("_g", "_level", node.alias("_node")).agg(F.sum(n).alias("_sum"))
    left = F.filter(levels, lambda j: F.call_function("shiftright", F.col(at), j).bitwiseAND(1) == 1)
    asked = counts.select("_g", at, F.explode(left).alias("_level")).withColumn("_node", node - 1)
    found = asked.join(sums, ["_g", "_level", "_node"]).groupBy("_g", at).agg(F.sum("_sum").alias(out))
    return counts.join(found, ["_g", at], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def placed_rows(df: DataFrame, keys: Sequence[str], order: Sequence, shards: int | None = None) -> DataFrame:
    """Adds 0-based `position` by `order` within keys, and `group_rows`, for groups of any size and any number of groups.

    Rows are dealt by ranges of (keys, order) and sorted inside a range; a row's position is its place in its range plus the counts of the
    group's earlier ranges, which prefix_sums adds up. No task holds more than one range, and only rows that are equal in keys and order
    always lie in the same one. Null keys form a group; order is ascending with nulls first unless a column says otherwise.
    """
    spark = df.sparkSession
    shards = shards or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [*[F.col(k) for k in keys], *order]
    dealt = df.repartitionByRange(shards, *by).sortWithinPartitions(*by)
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(1).alias("one"))
    numbered = store_table(dealt.withColumn("_row", F.monotonically_increasing_id()), "placed")
    # the upper bits of the number name the range, the lower ones count its rows
    numbered = numbered.withColumns({"_g": group, "_range": F.shiftright("_row", 33)})
    counts = store_table(numbered.groupBy("_g", "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")), "ranges")
    whole = counts.groupBy("_g").agg(F.sum("_n").alias("group_rows"))
    offsets = prefix_sums(counts, "_range", "_n", "_before").join(whole, "_g").select("_g", "_range", "_first", "_before", "group_rows")
    return (
        numbered.join(offsets, ["_g", "_range"])
        .withColumn("position", F.col("_before") + F.col("_row") - F.col("_first"))
        .drop("_g", "_range", "_row", "_first", "_before")
    )


BUCKETS = 4096  # of one pass over a bracket


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str = "quantile") -> DataFrame:
    """Exact linear-interpolated quantile per group, by counting: no group is sorted or gathered, whatever its size.

    Values are dealt to buckets that keep their order, first by sign and binary exponent, then, inside the bucket that holds a wanted rank, to BUCKETS even slices between
    that bucket's smallest and largest value, and so on. A rank is found once its bucket holds one value only, or it is the bucket's first or last. A pass
    at least halves the exponent or cuts the bracket to a four-thousandth, so few are needed; equal values are one value in all of them. Both ranks between which the quantile lies go
    together, and groups that are done take no part in later passes.
    """
    if not keys:
        # one group in all
        return exact_quantile(df.withColumn("_all", F.lit(1)), ["_all"], value, p, name).drop("_all")
    keys = list(keys)
    v = F.col("_v")
    rows = store_table(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), "values")
    exponent = F.when(F.isnan(v), 5000).when(F.abs(v) == float("inf"), F.signum(v) * 4000).when(v == 0, 0)
    exponent = exponent.otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v))) + 2000)).cast("int")

    def counted(dealt: DataFrame, by: Sequence[str]) -> DataFrame:
        return dealt.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))

    first = store_table(counted(rows.withColumn("_b", exponent), keys), "buckets")
    total = first.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    place = F.lit(p) * (F.col("_n") - 1)
    total = store_table(total.withColumn("_w", place - F.floor(place)).withColumn("_k", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))), "ranks")
    hist, target = first.join(total.select(*keys, F.col("_k").alias("_rank"), F.col("_k").alias("_id")), keys), [*keys, "_id"]
    found = None
    while True:
        # at most BUCKETS rows per group and rank
        order = Window.partitionBy(*target).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        inside = hist.withColumn("_at", F.col("_rank") - F.coalesce(F.sum("_c").over(order), F.lit(0)))
        inside = store_table(inside.filter((F.col("_at") >= 0) & (F.col("_at") < F.col("_c"))), "brackets")
        done = (F.col("_lo") == F.col("_hi")) | (F.col("_at") == 0) | (F.col("_at") == F.col("_c") - 1)
        is_last = (F.col("_at") == F.col("_c") - 1) & (F.col("_at") > 0)
        part = inside.filter(done).select(*target, F.when(is_last, F.col("_hi")).otherwise(F.col("_lo")).alias("_v"))
        found = part if found is None else found.unionByName(part)
        rest = inside.filter(~done).select(*target, F.col("_at").alias("_rank"), F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
        if rest.isEmpty():
            break
        near = salted_join(rows, rest, keys).filter(v.between(F.col("_from"), F.col("_to")))
        slice_ = F.least(F.floor((v - F.col("_from")) / (F.col("_to") - F.col("_from")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        hist = store_table(counted(near.withColumn("_b", slice_), [*target, "_rank"]), "buckets")
    both = total.join(found.withColumnRenamed("_id", "_k"), [*keys, "_k"]).groupBy(*keys).agg(
        F.min_by("_v", "_k").alias("_a"), F.max_by("_v", "_k").alias("_z"), F.max("_w").alias("_w")
    )
    return both.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_w")).alias(name))
