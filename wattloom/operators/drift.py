"""Efficiency drift per building: Mann-Kendall trend test with the median pairwise slope, exact at every size.

A building whose points fit in one block is settled by that block's task. Larger ones are settled by counts over blocks, as follows.

Ratios are whole numbers of 1e-9, so a pair's slope is a fraction of whole numbers and compares exactly. How many slopes lie below a probe is the number
of pairs that the order along that slope turns round: counted block by block for all probes at once, and across blocks from ranks and a table of cells. A
pass counts a few probes per building, taken from a sample of pairs; the counts cover all pairs and bracket the middle ranks. A rank is found when a
probe holds it among its equals, or when its bracket holds so few pairs that they are listed. So the result is a pair's slope at every size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import DriftConfig
from wattloom.operators.ranking import placed_rows, position_in_group
from wattloom.operators.scope import drift_context
from wattloom.operators.sharding import spread
from wattloom.operators.skew import salted_join
from wattloom.session import store_table

KEYS = ["tenant_id", "building_id"]
UNIT = 10**9  # ratios are settled at nine digits
LARGEST = 2.0e9  # ratios beyond it, up or down, count as it
SAMPLE = 2**18  # sampled pairs of a building, at most
LISTED, MOST_LISTED = 32, 2**22  # pairs that are listed: 32 a point, four million a building
PASSES = 24  # brackets that so many passes leave wider are listed as they are
CELL = 1024  # ranks that meet in one task when pairs are listed


def efficiency_ratios(readings: DataFrame) -> DataFrame:
    """kWh over baseline for rows that are not quarantined and have a positive baseline."""
    return readings.filter(
        (F.col("data_quality_status") != "quarantined") & F.col("kwh").isNotNull() & (F.col("rolling_baseline_kwh") > 0)
    ).select(*KEYS, "circuit_id", "ts", F.round(F.col("kwh") / F.col("rolling_baseline_kwh"), 9).alias("ratio"))


def thresholds(cfg: DriftConfig) -> tuple[Column, Column]:
    """(alpha, min points) per row: the type and zone's entry, the type's default, the default."""
    alpha, points = F.lit(cfg.alpha), F.lit(cfg.min_points)
    exact = F.concat_ws(":", "building_type", "climate_zone")
    by_type = F.concat_ws(":", "building_type", F.lit("default"))
    for test in (by_type, exact):
        for key, (a, p) in cfg.overrides.items():
            alpha = F.when(test == key, a).otherwise(alpha)
            points = F.when(test == key, p).otherwise(points)
    return alpha, points


def _sign_counts(points: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one block whose slope is below each probe, and those that equal it."""
    import numpy as np

    from wattloom.functions.trend import pair_sign_sum, slope_order, tied_pairs

    points = points.sort_values("position")
    at, x = points["position"].to_numpy(np.int64), points["x"].to_numpy(np.int64)
    out = pd.DataFrame({**{c: [probes[c].iloc[0]] * len(probes) for c in KEYS}, "p": probes["p"].to_numpy(), "q": probes["q"].to_numpy()})
    ranks = [slope_order(x, at, int(p), int(q)) for p, q in zip(out["p"], out["q"])]
    out["equal"] = [tied_pairs(r) for r in ranks]
    pairs = len(x) * (len(x) - 1) // 2
    out["below"] = [(pairs - e - pair_sign_sum(r)) // 2 for e, r in zip(out["equal"], ranks)]
    return out


def _bucket_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Falling pairs of one bucket of ranks whose ends lie in different blocks."""
    from wattloom.functions.trend import falling_pairs

    pdf = pdf.sort_values("position")
    n = falling_pairs(pdf["rank"].to_numpy()) - sum(falling_pairs(g["rank"].to_numpy()) for _, g in pdf.groupby("block"))
    return pdf[PROBE].head(1).assign(below=n, equal=0)


PROBE = [*KEYS, "p", "q"]
COUNTS = "tenant_id string, building_id string, p long, q long, below long, equal long"
INSIDE = "tenant_id string, building_id string, slope double, k long"


def _limbs() -> tuple[Column, Column]:
    """q * x - p * position in two parts, the upper one and the lower 32 bits, so that the order along a slope p / q is exact."""
    low, mask = "({0} & 4294967295)", "4294967295"
    high = "q * shiftright(x, 32) - position * shiftright(p, 32)"
    rest = f"(q * {low.format('x')} - position * {low.format('p')})"
    return F.expr(f"{high} + shiftright({rest}, 32)"), F.expr(f"{rest} & {mask}")


def _across_blocks(points: DataFrame, probes: DataFrame, rows: int) -> DataFrame:
    """Counts of the pairs of buildings of several blocks whose ends lie in different ones: inside buckets of ranks, between cells of (block, bucket), and among equals."""
    high, low = _limbs()
    copies = salted_join(points, probes, KEYS).withColumns({"zh": high, "zl": low})
    ranked = placed_rows(copies.withColumnRenamed("position", "_at"), PROBE, ["zh", "zl", "_at"]).withColumnRenamed("position", "rank")
    ranked = ranked.withColumnRenamed("_at", "position").withColumn("bucket", F.expr(f"rank div {rows}"))
    same = ranked.select(*PROBE, "bucket", "rank", "position", "block")
    inside = spread(same, *PROBE, "bucket").groupBy(*PROBE, "bucket").applyInPandas(_bucket_counts, COUNTS)

    # every cell of the grid, empty ones too: a building has as many buckets as blocks
    group = Window.partitionBy(*PROBE)
    parts = F.sequence(F.lit(0), F.expr(f"(n - 1) div {rows}"))
    grid = salted_join(probes, points.groupBy(*KEYS).agg(F.max("n").alias("n")), KEYS)
    grid = grid.select(*PROBE, F.explode(parts).alias("block"), parts.alias("_b")).select(*PROBE, "block", F.explode("_b").alias("bucket"))
    filled = ranked.groupBy(*PROBE, "block", "bucket").agg(F.count(F.lit(1)).alias("c"))
    cells = grid.join(filled, [*PROBE, "block", "bucket"], "left").fillna(0, ["c"])
    earlier = Window.partitionBy(*PROBE, "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy(*PROBE, "block").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    cells = cells.withColumn("above", F.coalesce(F.sum("before").over(higher), F.lit(0)))
    between = cells.groupBy(*PROBE).agg(F.sum(F.col("c") * F.col("above")).alias("below"), F.lit(0).cast("long").alias("equal"))

    t = ranked.groupBy(*PROBE, "zh", "zl", "block").agg(F.count(F.lit(1)).alias("c")).groupBy(*PROBE, "zh", "zl")
    t = t.agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("own"))
    ties = t.groupBy(*PROBE).agg(F.lit(0).cast("long").alias("below"), F.sum(F.expr("(t * t - own) div 2")).alias("equal"))
    return inside.unionByName(between).unionByName(ties)


def slope_counts(points: DataFrame, blocks: DataFrame, probes: DataFrame, rows: int) -> DataFrame:
    """(keys, p, q, below, equal): pairs of points whose slope is less than p / q, and equal to it, for every probe of a building.

    A block of `rows` positions counts its own pairs for all probes at once; pairs across blocks exist in buildings of more than one block only.
    """
    group = [*KEYS, "block"]
    points = salted_join(points, probes.select(*KEYS).distinct(), KEYS, "left_semi")
    left = spread(points.select(*group, "position", "x"), *group).groupBy(*group)
    right = spread(probes.join(blocks, KEYS), *group).groupBy(*group)
    own = left.cogroup(right).applyInPandas(_sign_counts, COUNTS)
    large = points.filter(F.col("n") > rows)
    both = own if large.isEmpty() else own.unionByName(_across_blocks(large, probes, rows))
    return store_table(both.groupBy(*PROBE).agg(F.sum("below").alias("below"), F.sum("equal").alias("equal")), "slope-counts")


def _sampled_slopes(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """Slopes p / q of random pairs, at most SAMPLE a building. They choose probes; what the probes decide is counted over all pairs."""
    drawn = sizes.select(*KEYS, "n", F.explode(F.sequence(F.lit(1), F.least(4 * F.col("n"), F.lit(SAMPLE)))).alias("s"))
    i, j = [F.pmod(F.xxhash64(*KEYS, "s", F.lit(end)), F.col("n")) + 1 for end in ("first", "second")]
    drawn = drawn.select(*KEYS, F.least(i, j).alias("i"), F.greatest(i, j).alias("j")).filter("i < j")
    for end in ("i", "j"):
        drawn = drawn.join(points.select(*KEYS, F.col("position").alias(end), F.col("x").alias("x" + end)), [*KEYS, end])
    return store_table(drawn.select(*KEYS, F.expr("xj - xi").alias("p"), F.expr("j - i").alias("q")).withColumn("slope", F.col("p") / F.col("q")), "slopes")


def _probes(sample: DataFrame, open_: DataFrame) -> DataFrame:
    """Probes inside the bracket of every open rank: sampled slopes around its likely place, and even steps once the sample has few left."""
    rank = Window.partitionBy(*KEYS, "k")
    inside = sample.join(open_, KEYS).filter((F.col("slope") > F.col("lo")) & (F.col("slope") < F.col("hi")))
    inside = inside.withColumns({"_i": F.row_number().over(rank.orderBy("slope", "q", "p")), "_h": F.count(F.lit(1)).over(rank)})
    middle = (F.col("k") - F.col("below")) / (F.col("upto") - F.col("below")) * F.col("_h")
    wanted = F.array(*[F.greatest(F.lit(1), F.least(F.col("_h"), F.round(middle + d * F.sqrt("_h")))) for d in (-1.6, -0.6, -0.2, 0.0, 0.2, 0.6, 1.6)])
    near = inside.filter(F.array_contains(wanted.cast("array<int>"), F.col("_i"))).select(*KEYS, "k", "_h", "p", "q")
    few = open_.join(near.groupBy(*KEYS, "k").agg(F.max("_h").alias("_h")), [*KEYS, "k"], "left").filter(F.coalesce("_h", F.lit(0)) < 24)
    steps = few.select(*KEYS, F.explode(F.array(*[F.col("lo") + (F.col("hi") - F.col("lo")) * (g / 8) for g in range(1, 8)])).alias("_t"))
    steps = steps.withColumn("q", F.when(F.abs("_t") < 2.0**31, F.lit(2**30)).otherwise(F.lit(1)).cast("long"))
    steps = steps.select(*KEYS, F.round(F.col("_t") * F.col("q")).cast("long").alias("p"), "q")
    return near.select(*PROBE).unionByName(steps)


def _narrowed(state: DataFrame, counts: DataFrame) -> DataFrame:
    """The brackets after a pass. A probe that holds the rank among its equals is the answer."""
    upto = F.col("_c.below") + F.col("_c.equal")
    hit = (F.col("_c.below") < F.col("k")) & (F.col("k") <= upto)
    row = F.struct("p", "q", "below", "equal").alias("_c")
    tried = state.select(*KEYS, "k").join(counts.select(*KEYS, row), KEYS)
    left, right = upto < F.col("k"), F.col("_c.below") >= F.col("k")
    ends = tried.groupBy(*KEYS, "k").agg(
        F.max(F.when(hit, F.col("_c.p") / F.col("_c.q"))).alias("_found"),
        F.max_by("_c", F.when(left, upto)).alias("_left"), F.max(F.when(left, upto)).alias("_below"),
        F.min_by("_c", F.when(right, F.col("_c.below"))).alias("_right"), F.min(F.when(right, F.col("_c.below"))).alias("_upto"),
    )
    out = state.join(ends, [*KEYS, "k"], "left")
    up = F.coalesce(F.col("_below") > F.col("below"), F.lit(False))
    down = F.coalesce(F.col("_upto") < F.col("upto"), F.lit(False))

    def end(moved: Column, name: str, new: str) -> Column:
        return F.when(moved, F.col(new)).otherwise(F.col(name)).alias(name)

    return store_table(
        out.select(
            *KEYS, "k", "n", end(up, "lo_p", "_left.p"), end(up, "lo_q", "_left.q"), end(up, "below", "_below"),
            end(down, "hi_p", "_right.p"), end(down, "hi_q", "_right.q"), end(down, "upto", "_upto"), F.coalesce("found", "_found").alias("found"),
        ).withColumns({"lo": F.col("lo_p") / F.col("lo_q"), "hi": F.col("hi_p") / F.col("hi_q")}), "brackets",
    )


def _crossings(pdf: pd.DataFrame) -> pd.DataFrame:
    """Slopes of the pairs that change order between both ends of a bracket, each pair in the cell where the later of its two spans begins."""
    import numpy as np

    pdf = pdf.sort_values("a")
    a, b, at, x = (pdf[c].to_numpy(np.int64) for c in ("a", "b", "position", "x"))
    home = np.minimum(a, b) // CELL
    cell, slopes = pdf["cell"].iloc[0], []
    for i in range(len(a)):
        j = i + 1 + np.flatnonzero(b[i + 1 :] < b[i])
        j = j[np.maximum(home[i], home[j]) == cell]
        slopes.append((x[j] - x[i]) / (at[j] - at[i]))
    found = np.concatenate(slopes)
    return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(found) for c in KEYS}, "slope": found, "k": pdf["k"].iloc[0]})


def _listed(points: DataFrame, state: DataFrame) -> DataFrame:
    """(keys, k, found) of ranks whose bracket holds few enough pairs to list them.

    A pair lies inside (lo, hi) exactly if the orders along both slopes disagree about it. Then the spans between the two ranks of its points overlap, so points
    meet in cells of CELL ranks. All spans together are no longer than twice the listed pairs, and at most the root of their number crosses a cell's edge in one direction.
    """
    high, low = _limbs()
    rows = salted_join(points.select(*KEYS, "position", "x"), state.filter(F.col("found").isNull()).select(*KEYS, "k", "lo_p", "lo_q", "hi_p", "hi_q"), KEYS)
    group = [*KEYS, "k"]
    for name, p, q, ties in (("a", "lo_p", "lo_q", F.desc("_at")), ("b", "hi_p", "hi_q", F.asc("_at"))):
        z = rows.withColumns({"p": F.col(p), "q": F.col(q)}).withColumns({"zh": high, "zl": low}).withColumnRenamed("position", "_at")
        placed = placed_rows(z, group, [F.col("zh"), F.col("zl"), ties])
        rows = placed.withColumnRenamed("position", name).withColumnRenamed("_at", "position").drop("p", "q", "zh", "zl", "group_rows")
    span = F.sequence(F.expr(f"least(a, b) div {CELL}"), F.expr(f"greatest(a, b) div {CELL}"))
    cells = rows.select(*group, "a", "b", "position", "x", F.explode(span).alias("cell"))
    slopes = spread(cells, *group, "cell").groupBy(*group, "cell").applyInPandas(_crossings, INSIDE)
    ranked = slopes.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy("slope")))
    return ranked.join(state.select(*group, "below"), group).filter(F.col("_i") == F.col("k") - F.col("below")).select(*group, F.col("slope").alias("found"))


STATS = "tenant_id string, building_id string, n long, s long, _ties double, slope double"


def _block_trend(pdf: pd.DataFrame) -> pd.DataFrame:
    """Statistics of a building of one block."""
    import numpy as np

    from wattloom.functions.trend import median_slope, pair_sign_sum

    pdf = pdf.sort_values("position")
    at, x = pdf["position"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
    t = np.unique(x, return_counts=True)[1].astype(float)
    slope = median_slope(x, at) / UNIT if len(x) > 1 else None
    return pdf[KEYS].head(1).assign(n=len(x), s=pair_sign_sum(x), _ties=float((t * (t - 1) * (2 * t + 5)).sum()), slope=pd.Series([slope], dtype=float, index=pdf.index[:1]))


def trend_statistics(ratios: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """(keys, n, s, z, slope) for every building; a building of one point has no slope."""
    ratios = ratios.withColumn("x", F.round(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.col("ratio"))) * UNIT).cast("long"))
    points = position_in_group(ratios, KEYS, "ts", ["circuit_id"])
    block = F.expr(f"(position - 1) div {cfg.block_rows}")
    points = store_table(points.select(*KEYS, F.col("position").cast("long").alias("position"), "x", F.col("group_rows").cast("long").alias("n"), block.alias("block")), "points")
    small = points.filter(F.col("n") <= cfg.block_rows).select(*KEYS, "position", "x")
    out = spread(small, *KEYS).groupBy(*KEYS).applyInPandas(_block_trend, STATS)
    large = points.filter(F.col("n") > cfg.block_rows)
    if not large.isEmpty():
        out = out.unionByName(_statistics_by_blocks(large, cfg))
    n = F.col("n").cast("double")
    var = (n * (n - 1) * (2 * n + 5) - F.col("_ties")) / 18
    z = F.when((F.col("s") == 0) | (var <= 0), 0.0).otherwise((F.col("s") - F.signum("s")) / F.sqrt(var))
    return out.select(*KEYS, "n", "s", z.alias("z"), "slope")


def _statistics_by_blocks(points: DataFrame, cfg: DriftConfig) -> DataFrame:
    """STATS of buildings of several blocks."""
    blocks = store_table(points.select(*KEYS, "block").distinct(), "blocks")
    sizes = store_table(points.groupBy(*KEYS).agg(F.max("n").alias("n"), (F.max("x") - F.min("x") + 1).alias("_edge")), "sizes")
    pairs = F.expr("n * (n - 1) div 2")
    ranks = F.array_distinct(F.array(F.expr("(n * (n - 1) div 2 + 1) div 2"), F.expr("n * (n - 1) div 2 div 2 + 1")))
    state = sizes.filter("n > 1").select(
        *KEYS, "n", F.explode(ranks).alias("k"), (-F.col("_edge")).alias("lo_p"), F.lit(1).cast("long").alias("lo_q"), F.lit(0).cast("long").alias("below"),
        F.col("_edge").alias("hi_p"), F.lit(1).cast("long").alias("hi_q"), pairs.alias("upto"), F.lit(None).cast("double").alias("found"),
    ).withColumns({"lo": F.col("lo_p").cast("double"), "hi": F.col("hi_p").cast("double")})
    state = store_table(state, "brackets")
    many = F.col("found").isNull() & (F.col("upto") - F.col("below") > F.least(F.col("n") * LISTED, F.lit(MOST_LISTED)))
    sample = _sampled_slopes(points, state.filter(many).select(*KEYS, "n").distinct())
    flat = sizes.select(*KEYS, F.lit(0).cast("long").alias("p"), F.lit(1).cast("long").alias("q"))
    signs = None
    for _ in range(PASSES):
        open_ = state.filter(many)
        if signs is not None and open_.isEmpty():
            break
        probes = _probes(sample, open_)
        probes = store_table((probes if signs is not None else probes.unionByName(flat)).distinct(), "probes")
        counts = slope_counts(points, blocks, probes, cfg.block_rows)
        if signs is None:
            signs = counts.filter("p = 0 AND q = 1").select(*KEYS, F.col("below").alias("_falling"), F.col("equal").alias("_level"))
        state = _narrowed(state, counts)
    found = state.select(*KEYS, "k", "found").filter(F.col("found").isNotNull()).unionByName(_listed(points, state).select(*KEYS, "k", "found"))
    slopes = found.groupBy(*KEYS).agg((F.avg("found") / UNIT).alias("slope"))
    t = F.col("t").cast("double")
    ties = points.groupBy(*KEYS, "x").agg(F.count(F.lit(1)).alias("t")).groupBy(*KEYS).agg(F.sum(t * (t - 1) * (2 * t + 5)).alias("_ties"))
    out = sizes.join(signs, KEYS).join(ties, KEYS).join(slopes, KEYS, "left").withColumn("s", pairs - 2 * F.col("_falling") - F.col("_level"))
    return out.select(*KEYS, "n", "s", "_ties", "slope")


def detect(readings: DataFrame, buildings: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Status, direction and magnitude per building; too few points are stable without magnitude."""
    from wattloom.functions.trend import critical

    stats = trend_statistics(efficiency_ratios(readings), cfg)
    every = drift_context(readings.select(*KEYS).distinct(), buildings)
    alpha, points = thresholds(cfg)
    levels = sorted({cfg.alpha, *[a for a, _ in cfg.overrides.values()]})
    limit = F.lit(None).cast("double")
    for a in levels:
        limit = F.when(F.col("_alpha") == a, critical(a)).otherwise(limit)
    out = every.join(stats, KEYS, "left").withColumns({"_alpha": alpha, "_points": points})
    enough = F.coalesce(F.col("n") >= F.col("_points"), F.lit(False))
    moving = enough & (F.abs("z") > limit)
    return out.select(
        *KEYS,
        F.coalesce("n", F.lit(0)).cast("long").alias("n_points"),
        F.when(moving, "drifting").otherwise("stable").alias("status"),
        F.when(moving & (F.col("z") > 0), "increasing").when(moving, "decreasing").otherwise("none").alias("trend_direction"),
        F.when(enough, F.col("slope")).alias("magnitude"),
    )
