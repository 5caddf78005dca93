"""Mixing sources to target weights: Efraimidis-Spirakis sampling without replacement, in whole epochs and a fraction.

Each document draws an exponential key `-ln(u) / w`, where `u` is a hash of its id and text and `w` its quality weight. Sorted by key,
a source's documents are taken until its budget of words is reached; budgets of one source size or more first take every document
once per complete epoch.

Only DataFrame functions. A source of any size is never sorted in one task: keys fall into ordered buckets of about `BUCKET` documents,
bucket sizes are summed before they are moved, and only the bucket in which the budget ends is sorted.

Defined results: no text has no words, size 0, and is taken in whole epochs only (0 words). A null source is a source, ordered last.
Sources without words get target 0. Rows that repeat (same id and text) share a key and are told apart by their place in the written
table, which does not change the result as a bag of rows. Empty tables give empty results. Input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import settle, small_join, word_count

SEED = "mix-1"
BUCKET = 4096
WEIGHTS = (5.0, 2.0, 1.0)  # of the sources in order, repeating
SHARE, MOST = 1.5, 2.0  # words of the mix per word of the input; most words of a source per word it has


def quality_weight(text: Column, size: Column) -> Column:
    """1 for texts of at least five words of usual length, else one half."""
    per_word = F.length(F.coalesce(text, F.lit(""))) / F.when(size > 0, size)
    return F.when((size >= 5) & per_word.between(3.0, 12.0), F.lit(1.0)).otherwise(F.lit(0.5))


def unit_draw(*parts: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a digest; the same for the same parts, in any engine."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def with_keys(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds `size` (words) and `mix_key` to documents."""
    sized = docs.withColumn("size", word_count(F.col("text")))
    u = unit_draw(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))), seed=seed)
    return sized.withColumn("mix_key", -F.log(u) / quality_weight(F.col("text"), F.col("size")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`target` per source from (source, source_size): shares by weight, capped, the excess reshared among the rest.

    Sources leave in the order of cap per weight; the level at which the first one stays below its cap is where resharing ends.
    One row per source only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * most).withColumn("_r", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_r", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    s = s.withColumn("_level", (total - before) / left)
    level = F.max(F.when(F.col("_level") <= F.col("_r"), F.col("_level"))).over(Window.partitionBy())
    target = F.round(F.least(F.coalesce(level, F.lit(0.0)) * F.col("_w"), F.col("_cap")), 6)
    return s.select("source", "source_size", "_n", target.alias("target"))


def mix(keyed: DataFrame, **settings) -> DataFrame:
    """Adds `source_size`, `target`, `copies` (how often the mix takes the document) and `taken` (words) to documents with keys."""
    spark_row = F.monotonically_increasing_id()
    rows = keyed.drop("source_size", "target", "copies", "taken").withColumn("_tie", spark_row)
    rows = settle(rows, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    goal = source_targets(sizes, **settings)
    # joins on null-safe names: a null source is a source
    named = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.select(
        named.alias("_src"), "source_size", "target", epochs.alias("_epochs"),
        (F.col("target") - epochs * F.col("source_size")).alias("_rest"), (F.floor(F.col("_n") / BUCKET) + 1).alias("_buckets"),
    )
    goal = settle(goal, "mix-goal")
    spread = F.floor((1 - F.exp(-F.col("mix_key"))) * F.col("_buckets")).cast("long")
    placed = small_join(rows.withColumn("_src", named), goal, ["_src"]).withColumn("_b", F.least(spread, F.col("_buckets") - 1))

    sums = placed.groupBy("_src", "_b").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"))
    run = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("_before", F.coalesce(F.sum("_words").over(run), F.lit(0)))
    # the bucket in which the rest of the budget ends; buckets before it are whole
    last = ends.filter(F.col("_before") < F.col("_rest")).groupBy("_src").agg(F.max(F.struct("_b", "_before")).alias("_x"))
    last = settle(last.select("_src", F.col("_x._b").alias("_last"), F.col("_x._before").alias("_before")), "mix-last")
    inside = small_join(placed, last, ["_src"]).filter(F.col("_b") == F.col("_last"))
    order = Window.partitionBy("_src").orderBy("mix_key", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    # a document belongs to the mix if at least half of it lies within the budget
    fits = inside.select("_src", "mix_key", "doc_id", "_tie", (begin + F.col("size") / 2 <= F.col("_rest")).alias("_fits"))
    bound = fits.filter("_fits").groupBy("_src").agg(F.max(F.struct("mix_key", "doc_id", "_tie")).alias("_bound"))
    bound = settle(last.join(bound, "_src", "left").select("_src", "_last", "_bound"), "mix-bound")

    chosen = (F.col("_b") < F.col("_last")) | ((F.col("_b") == F.col("_last")) & (F.struct("mix_key", "doc_id", "_tie") <= F.col("_bound")))
    out = small_join(placed, bound, ["_src"], "left")
    copies = F.col("_epochs") + F.when(chosen, F.lit(1)).otherwise(F.lit(0))
    out = out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("_src", "_tie", "_epochs", "_rest", "_buckets", "_b", "_last", "_bound", "mix_key")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of the input."""
    out = mix(with_keys(docs))
    again = out.filter(F.col("copies") > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
