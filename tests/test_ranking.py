"""Positions, prefix sums and quantiles of groups of any size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators.ranking import exact_quantile, placed_rows, prefix_sums
from wattloom.session import store_table


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_quantiles_of_any_values(spark, p):
    rng = random.Random(1)
    groups = {
        "tiny": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 999 + [7.0], "signs": [rng.uniform(-1, 1) for _ in range(500)],
        "scales": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(400)], "close": [1.0 + i * 2.0**-52 for i in range(300)], "zeros": [0.0, -0.0, 1e-320, -1e-320] * 20,
        "wide": [math.ldexp(1.0, k) for k in range(-1000, 1000, 7)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("tiny", None), ("none", None)]
    rng.shuffle(rows)
    got = {r["g"]: r["quantile"] for r in exact_quantile(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", p).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        s = sorted(vs)
        place = p * (len(s) - 1)
        a, b = s[math.floor(place)], s[math.ceil(place)]
        assert got[g] == pytest.approx(a + (b - a) * (place - math.floor(place)), rel=1e-12, abs=0), g


def test_quantile_of_one_large_group(spark):
    df = spark.range(300_000).select((F.xxhash64("id") / F.lit(2.0**63)).alias("v")).unionByName(spark.createDataFrame([(0.25,)] * 1000, "v double"))
    (r,) = exact_quantile(df, [], "v", 0.4).collect()
    assert r["quantile"] == pytest.approx(np.quantile([x["v"] for x in df.collect()], 0.4), rel=1e-12)


def test_positions_and_prefix_sums(spark):
    df = spark.range(5000).select((F.col("id") % 5).alias("k"), F.xxhash64("id").alias("v")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    r = placed_rows(df, ["k"], [F.col("v")], 9).toPandas()
    r["k"] = r["k"].fillna(-1)
    r = r.sort_values(["k", "v"])
    assert (r.groupby("k").cumcount() == r["position"]).all() and (r["group_rows"] == 1000).all()
    counts = store_table(spark.createDataFrame([(g, i, i * 7 % 11) for g in "ab" for i in (0, 1, 2, 5, 8, 64, 65)], "g string, at long, n long").select(F.struct("g").alias("_g"), "at", "n"), "counts")
    got = {(r["_g"]["g"], r["at"]): r["before"] for r in prefix_sums(counts, "at", "n", "before").collect()}
    assert got == {(g, i): sum(j * 7 % 11 for j in (0, 1, 2, 5, 8, 64, 65) if j < i) for g in "ab" for i in (0, 1, 2, 5, 8, 64, 65)}


def test_global_positions_need_no_single_task(spark):
    from wattloom.operators.features import chronological_split

    df = spark.range(2000).select(F.timestamp_seconds(F.col("id") % 300 * 3600).alias("ts"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("circuit_id"))
    split = chronological_split(df, keys=())
    assert "SinglePartition" not in split._jdf.queryExecution().executedPlan().toString()
    want = [r["circuit_id"] for r in df.orderBy("ts", "circuit_id").collect()]
    assert [r["circuit_id"] for r in split.orderBy("position").collect()] == want


def test_intervals_cover_any_stamp(spark):
    """Raw stamps and circuit-wide intervals of years against every pair."""
    from datetime import datetime, timedelta

    from wattloom.operators.gate import apply_issues

    rng = random.Random(4)
    start = datetime(2019, 1, 1)
    at = lambda: start + timedelta(seconds=rng.randrange(0, 5 * 365 * 86_400))
    readings = [(f"c{i % 4}", at(), rng.choice(["pass", "pass", "degraded"])) for i in range(2000)]
    spans = [("c0", start, datetime(2030, 1, 1), "degraded"), ("c1", readings[1][1], None, "quarantined")]
    for _ in range(60):
        a = at()
        spans.append((f"c{rng.randrange(3)}", a, a + timedelta(seconds=rng.choice([0, 50, 4000, 10**6, 10**8])), rng.choice(["degraded", "quarantined"])))
    spans += [("c2", readings[2][1], readings[2][1], "quarantined"), spans[5]]
    r = spark.createDataFrame(readings, "circuit_id string, ts timestamp, data_quality_status string")
    i = spark.createDataFrame(spans, "circuit_id string, ts_start timestamp, ts_end timestamp, severity string")
    rank = {"pass": 0, "degraded": 1, "quarantined": 2}
    want = sorted((c, t, max([s, *[v for k, a, b, v in spans if k == c and a <= t <= (b or a)]], key=rank.get)) for c, t, s in readings)
    assert sorted(map(tuple, apply_issues(r, i, ["circuit_id"]).select("circuit_id", "ts", "data_quality_status").collect())) == want
