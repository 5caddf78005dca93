"""Seeded and iterative operators by their properties, and large-group paths against small ones."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.config import DriftConfig, ForestConfig, WindowModelConfig
from wattloom.functions import isolation, loess, trend
from wattloom.operators import confidence, drift, forest, ranking, stl, window_model

START = dt.datetime(2026, 1, 5)


def feature_rows(spark, buildings=2, days=21, spikes=((0, 300),)):
    rng = np.random.default_rng(0)
    rows = []
    for b in range(buildings):
        for c in range(2):
            for h in range(days * 24):
                kwh = 10 + 4 * np.sin(np.pi * (h % 24) / 23) + rng.normal(0, 0.3)
                if c == 0 and (b, h) in spikes:
                    kwh = 210.0
                rows.append(("t", f"b{b}", f"b{b}-{c}", START + dt.timedelta(hours=h), float(kwh), 10.0, 1.0, 0.0, None, float(kwh / 10), float(abs(kwh - 10)), "business_day", {}, False))
    return spark.createDataFrame(
        rows, "tenant_id string, building_id string, circuit_id string, ts timestamp, kwh double, rolling_baseline_kwh double, peak_offpeak_split double, "
        "after_hours_kwh_ratio double, weekend_floor_load double, rolling_efficiency_ratio double, stl_residual_magnitude double, day_type string, rule_fire_indicators map<string,boolean>, low_data_quality boolean")


@pytest.fixture(scope="module")
def feats(spark):
    return feature_rows(spark).cache()


def test_decomposition_adds_up_and_finds_the_spike():
    h = np.arange(480)
    y = 10 + 4 * np.sin(2 * np.pi * h / 24) + np.random.default_rng(1).normal(0, 0.3, 480)
    y[200] += 40
    parts = loess.decompose(y)
    assert np.allclose(sum(parts), y)
    z = loess.robust_z(parts[2])
    assert np.argmax(np.abs(z)) == 200 and abs(z[200]) > 3


def test_robust_scores_agree_with_arrays(spark):
    x = np.random.default_rng(2).normal(size=101)
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, stl_residual double")
    got = np.sort([r.residual_zscore for r in stl.robust_scores(df, ["g"]).collect()])
    assert np.allclose(got, np.sort(loess.robust_z(x)))


def test_cold_cohorts_carry_reasons_and_no_scores(spark):
    df = spark.createDataFrame([("t", "b", "c", "weekend", START + dt.timedelta(hours=h), 1.0) for h in range(47)],
                               "tenant_id string, building_id string, circuit_id string, day_type string, ts timestamp, kwh double")
    r = stl.residuals(df).first()
    assert r.low_data_quality and r.stl_residual is None and "47 available" in r.low_data_quality_reason


def ratio_frame(spark, x, building="b"):
    rows = [("t", building, f"c{i % 3}", START + dt.timedelta(hours=i // 3), float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "tenant_id string, building_id string, circuit_id string, ts timestamp, ratio double")


def test_pair_counts_and_slopes_match_brute_force():
    x = np.round(np.random.default_rng(3).normal(size=400), 1)
    i, j = np.triu_indices(400, 1)
    assert trend.pair_sign_sum(x) == np.sign(x[j] - x[i]).sum()
    assert trend.falling_pairs(np.argsort(np.argsort(x, kind="stable"))) == (x[j] < x[i]).sum()
    assert trend.tied_pairs(x) == (x[j] == x[i]).sum()


def test_orders_along_a_slope_are_exact():
    rng = np.random.default_rng(11)
    x, at = rng.integers(-(2**61), 2**61, 300), np.sort(rng.choice(2**31 - 1, 300, replace=False))
    for p, q in ((2**61 + 7, 2**31 - 1), (-(2**61) - 1, 3), (int(x[5] - x[2]) // 2, int(at[5] - at[2])), (0, 1)):
        exact = [q * int(a) - p * int(b) for a, b in zip(x, at)]
        want = {v: i for i, v in enumerate(sorted(set(exact)))}
        assert trend.slope_order(x, at, p, q).tolist() == [want[v] for v in exact]


def brute_trend(x):
    i, j = np.triu_indices(len(x), 1)
    return np.sign(x[j] - x[i]).sum(), np.median((x[j] - x[i]) / (j - i)) if len(x) > 1 else None


def test_trend_statistics_match_brute_force_at_any_block_size(spark):
    rng = np.random.default_rng(5)
    series = {
        "ties": np.round(rng.normal(size=900) + np.arange(900) * 0.001, 1),
        "flat": np.full(700, 0.5),
        "steps": np.repeat(np.arange(8.0), 100),
        "noise": np.round(rng.normal(1, 0.3, 2500), 9),
        "falling": np.round(5 - np.arange(1201) * 0.003 + rng.standard_cauchy(1201), 9),
        "large": np.round(rng.normal(0, 1e6, 800), 3),
        "two": np.array([3.0, 1.0]), "one": np.array([4.0]), "short": np.round(rng.normal(size=64), 2),
    }
    r = None
    for name, x in series.items():
        part = ratio_frame(spark, x, name)
        r = part if r is None else r.unionByName(part)
    for rows in (100_000, 256):
        got = {g.building_id: g for g in drift.trend_statistics(r, DriftConfig(block_rows=rows)).collect()}
        assert set(got) == set(series)
        for name, x in series.items():
            s, slope = brute_trend(x)
            ties = np.unique(x, return_counts=True)[1]
            n = len(x)
            assert (got[name].n, got[name].s) == (n, s), (name, rows)
            assert np.isclose(got[name].z, trend.trend_z(s, n, int((ties * (ties - 1) * (2 * ties + 5)).sum()))), name
            assert got[name].slope is None if slope is None else np.isclose(got[name].slope, slope, rtol=1e-12, atol=1e-14), (name, rows)


def test_trend_of_no_rows(spark):
    assert drift.trend_statistics(ratio_frame(spark, [1.0]).limit(0)).collect() == []


def test_trend_sign_turns_with_the_series(spark):
    x = np.arange(40) + np.random.default_rng(6).normal(0, 1, 40)
    both = drift.trend_statistics(ratio_frame(spark, x).unionByName(ratio_frame(spark, x[::-1], "r"))).collect()
    s = {r.building_id: r.s for r in both}
    assert s["b"] == -s["r"] > 0


def test_exact_quantile_on_a_large_skewed_group(spark):
    x = np.concatenate([np.full(20_000, 3.0), np.random.default_rng(7).normal(size=40_000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    for p in (0.05, 0.5, 0.95):
        assert np.isclose(ranking.exact_quantile(df, [], "x", p).first()[0], np.quantile(x, p))


def test_attributions_add_up_and_equal_the_definition():
    from itertools import combinations
    from math import factorial

    rng = np.random.default_rng(8)
    x = rng.normal(size=(64, 3))
    f = isolation.grow_forest(x, 5, 32, 1)
    a = isolation.attributions(f, x)
    assert np.allclose(a.sum(1) + isolation.baseline(f, 3), isolation.mean_path(f, x))

    def game(row, known):
        total = 0.0
        for t in f:
            v, share, lo, hi = isolation._leaf_table(t, 3)
            inside = (row > lo) & (row <= hi)
            total += (v * np.prod([inside[:, j] if j in known else share[:, j] for j in range(3)], axis=0)).sum()
        return total / len(f)

    for i in range(3):
        rest = [j for j in range(3) if j != i]
        phi = sum(factorial(k) * factorial(2 - k) / 6 * (game(x[0], {*s, i}) - game(x[0], {*s})) for k in range(3) for s in combinations(rest, k))
        assert np.isclose(phi, a[0, i])


def test_forest_finds_the_spike_whatever_the_shards(spark, feats):
    cfg = ForestConfig(trees=40)
    m = forest.train(feats, cfg=cfg)
    one = {(r.circuit_id, r.ts): r.if_score for r in forest.score(feats, m, cfg).collect()}
    many = {(r.circuit_id, r.ts): r.if_score for r in forest.score(feats, m, ForestConfig(trees=40, shard_rows=100)).collect()}
    assert one == many and len(one) == feats.count()
    spike = ("b0-0", START + dt.timedelta(hours=300))
    assert one[spike] < 0 and one[spike] == min(v for k, v in one.items() if k[0].startswith("b0"))
    for r in m.models.collect():
        assert abs(r.train_anomaly_rate - 0.05) < 0.01 and r.n_features == 7


def test_trees_sample_the_whole_building_repeatably(spark, feats):
    cfg = ForestConfig(trees=30, sample=50)
    v = feats.select("tenant_id", "building_id", "circuit_id", "ts", F.array("kwh").alias("scaled"))
    a, b = (forest.tree_samples(v.repartition(n), cfg).select("building_id", "tree", "circuit_id", "ts", "_r").cache() for n in (3, 7))
    sizes = a.groupBy("building_id", "tree").count()
    assert sizes.filter("count <> 50").count() == 0 and sizes.count() == 60
    assert a.exceptAll(b).count() == 0
    # the draws of all trees reach most rows, and differ
    assert a.select("circuit_id", "ts").distinct().count() > 0.45 * feats.count()


def test_window_model_depends_on_its_building_only(spark, feats):
    """Equal weights alone and beside another building, and for any number of shards."""
    import numpy as np

    def weights(rows, **more):
        m = window_model.train(rows, WindowModelConfig(epochs=4, rounds=2, **more))
        return {r.building_id: np.array(r.weights) for r in m.weights.collect()}

    both, many = weights(feats), weights(feats, shard_rows=600)
    alone = weights(feats.filter("building_id = 'b1'"))
    assert np.allclose(both["b1"], alone["b1"], atol=1e-12) and all(np.allclose(both[b], many[b], atol=1e-9) for b in both)


def test_window_model_flags_a_flat_day_in_one_or_many_shards(spark, feats):
    flat = F.col("ts").between(START + dt.timedelta(days=15), START + dt.timedelta(days=15, hours=23)) & (F.col("circuit_id") == "b1-1")
    odd = feats.withColumns({"rolling_efficiency_ratio": F.when(flat, 1.2).otherwise(F.col("rolling_efficiency_ratio")), "stl_residual_magnitude": F.when(flat, 2.0).otherwise(F.col("stl_residual_magnitude"))})
    for cfg in (WindowModelConfig(epochs=20), WindowModelConfig(epochs=20, shard_rows=600, rounds=4)):
        m = window_model.train(feats, cfg)
        assert m.models.count() == 2
        rows = {(r.circuit_id, r.ts): r for r in window_model.score(odd, m, cfg).collect()}
        assert len(rows) == 4 * (21 * 24 - 23)
        assert rows["b1-1", START + dt.timedelta(days=15, hours=23)].ae_is_anomalous


def test_confidence_bands_are_ordered_and_cold_ones_wide(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=120)
    y = np.where(rng.random(120) < 1 / (1 + np.exp(-3 * x)), "confirmed", "dismissed")
    l = spark.createDataFrame([("t", "b", float(a), str(c)) for a, c in zip(x, y)] + [("t", "few", 1.0, "confirmed")] * 5 + [("t", "single", 1.0, "confirmed")] * 40,
                              "tenant_id string, building_id string, anomaly_score double, action string")
    p = confidence.fit(l)
    b = spark.createDataFrame([("t", n, False) for n in ("b", "few", "single")] + [("t", "cold", True)], "tenant_id string, building_id string, cold_start boolean")
    items = spark.createDataFrame([("t", n, s) for n in ("b", "few", "single", "cold", "unknown") for s in (-2.0, 0.0, 2.0)], "tenant_id string, building_id string, anomaly_score double")
    got = confidence.bands(items, p, b).collect()
    assert all(0 <= r.confidence_lower <= r.confidence_upper <= 1 for r in got)
    assert all((r.confidence_lower, r.confidence_upper) == (0.0, 1.0) for r in got if r.building_id != "b")
    assert {r.building_id for r in got if r.is_cold_start} == {"few", "cold", "unknown"}
    up = {r.anomaly_score: r.confidence_upper for r in got if r.building_id == "b"}
    assert up[-2.0] < up[2.0]


def test_drift_thresholds_by_type_and_zone(spark):
    r = ratio_frame(spark, np.arange(30.0)).withColumns({"kwh": F.col("ratio") + 1, "rolling_baseline_kwh": F.lit(1.0), "data_quality_status": F.lit("pass")})
    b = spark.createDataFrame([("t", "b", "office", "warm")], "tenant_id string, building_id string, building_type string, climate_zone string")
    assert drift.detect(r, b).first().trend_direction == "increasing"
    strict = DriftConfig(overrides={"office:default": (0.05, 10), "office:warm": (0.05, 31)})
    got = drift.detect(r, b, strict).first()
    assert got.status == "stable" and got.magnitude is None


def test_salted_joins_equal_plain_ones(spark):
    from wattloom.operators.skew import salted_join

    big = spark.createDataFrame([("hot", i, {"a": i}) for i in range(60)] + [("cold", 1, None), ("none", 2, None)], "k string, v int, m map<string,int>")
    small = spark.createDataFrame([("hot", 10), ("hot", 11), ("cold", 12)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = (j.withColumn("m", F.to_json("m")) for j in (salted_join(big, small, ["k"], how), big.join(small, ["k"], how)))
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    with pytest.raises(ValueError):
        salted_join(big, small, ["k"], "full_outer")


def test_residual_rows_that_break_their_contract(spark):
    from wattloom.operators.scope import residual_violations

    rows = [
        ("fine", False, None, 1.0, 0.5, 1.0, "weekend"), ("gap", True, "too few", None, None, None, "weekend"), ("no score", False, None, 1.0, None, 1.0, "weekend"),
        ("score", True, "too few", 1.0, None, None, "weekend"), ("no reason", True, None, None, None, None, "weekend"), ("odd day", False, None, 1.0, 0.5, 1.0, "someday"),
    ]
    df = spark.createDataFrame(rows, "name string, low_data_quality boolean, low_data_quality_reason string, stl_residual double, residual_zscore double, residual_magnitude double, day_type string")
    assert sorted(r["name"] for r in residual_violations(df).collect()) == ["no reason", "no score", "odd day", "score"]


def test_shards_without_a_full_window_train_nothing(spark):
    rows = feature_rows(spark, 1, 4)
    short = rows.filter(F.col("circuit_id") == "b0-1").orderBy("ts").limit(6)
    for i in range(6):
        rows = rows.unionByName(short.withColumn("circuit_id", F.lit(f"short{i}")))
    cfg = WindowModelConfig(epochs=1, rounds=1, shard_rows=20)
    model = window_model.train(rows, cfg)
    assert model.models.first().n_windows == 2 * (4 * 24 - 23)
