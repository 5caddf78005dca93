"""Work that grows with the rows only: jobs, folders and passes do not grow with the number of small groups."""

import datetime as dt
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_models import START, brute_trend, ratio_frame
from wattloom.config import ForestConfig
from wattloom.functions import isolation, loess, mlp, trend
from wattloom.operators import drift, forest, gate, stl
from wattloom.operators.skew import salted_join
from wattloom.plans.analyze import batch_features
from wattloom.session import configure
from wattloom.sinks import merge
from wattloom.sinks.snapshots import Conflict, SnapshotStore
from wattloom.sources.bounds import built_in_bounds
from wattloom.workbench import views


@pytest.mark.parametrize("listed", [2**22, 50, 3])
def test_median_slope_of_a_block_is_the_median_of_all_pairs(listed):
    rng = np.random.default_rng(3)
    for n in (2, 3, 64, 301):
        for x in (rng.normal(size=n), np.round(rng.normal(size=n), 1), np.full(n, 0.25), rng.standard_cauchy(n)):
            units = np.rint(x * 1e9).astype(np.int64)
            assert np.isclose(trend.median_slope(units, np.arange(1, n + 1), listed), brute_trend(units)[1], rtol=1e-12, atol=0)


def test_buildings_of_one_block_need_no_passes_over_tables(spark, monkeypatch):
    def passed(*_):
        raise AssertionError("a pass over all tables for small buildings")

    monkeypatch.setattr(drift, "slope_counts", passed)
    x = np.round(np.random.default_rng(4).normal(1, 0.3, 60), 3)
    r = ratio_frame(spark, x).unionByName(ratio_frame(spark, x[::-1], "r")).unionByName(ratio_frame(spark, x[:1], "one"))
    got = {g.building_id: g for g in drift.trend_statistics(r).collect()}
    assert got["b"].s == -got["r"].s == brute_trend(x)[0] and got["one"].slope is None
    assert np.isclose(got["b"].slope, brute_trend(x)[1], rtol=1e-12)


def one_tree(x, rng):
    """A tree by itself, node by node."""
    tree, limit = [[-1, 0.0, -1, -1, len(x), 0]], int(np.ceil(np.log2(max(len(x), 2))))
    stack = [(0, x)]
    while stack:
        node, rows = stack.pop()
        wide = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and tree[node][5] < limit else []
        if not len(wide):
            continue
        f = int(rng.choice(wide))
        t = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        tree[node][:2] = f, t
        for side, part in ((2, rows[rows[:, f] <= t]), (3, rows[rows[:, f] > t])):
            tree[node][side] = len(tree)
            tree.append([-1, 0.0, -1, -1, len(part), tree[node][5] + 1])
            stack.append((tree[node][side], part))
    return tree


def test_trees_that_grow_together_are_those_that_grow_alone():
    rng = np.random.default_rng(9)
    samples = [np.round(rng.normal(size=(n, 4)), 1) for n in (1, 2, 40, 256)] + [np.ones((30, 4))]
    grown = isolation.grow_together(samples, [np.random.default_rng([1, k]) for k in range(len(samples))])
    for k, (x, tree) in enumerate(zip(samples, grown)):
        assert [list(node) for node in zip(*tree.values())] == one_tree(x, np.random.default_rng([1, k]))


def test_smoothing_works_out_its_weights_once(monkeypatch):
    """Neighbour weights depend on the length only, and those of robust steps hold for all inner passes."""
    built, plain = [], loess.smoother
    monkeypatch.setattr(loess, "smoother", lambda *a: built.append(a) or plain(*a))
    y = np.random.default_rng(2).normal(size=137)
    parts = loess.decompose(y, inner=4, outer=1)
    assert np.allclose(sum(parts), y)
    assert len(built) <= 2 * (1 + 6) + 1
    assert np.array_equal(loess.decompose(y, inner=4, outer=1), parts)


def test_smoothing_by_correlation_is_that_by_neighbours():
    rng = np.random.default_rng(5)
    for n, span in ((2, 35), (13, 35), (35, 35), (36, 35), (64, 39), (301, 39), (301, 24)):
        w = rng.random((3, n)) * (rng.random((3, n)) < 0.6)
        w[1] = 0
        w[2, : n // 2] = 0
        y = rng.normal(size=(3, n))
        assert np.allclose(loess.smoother(n, span, w)(y), loess.plain_smoother(n, span, w)(y), rtol=1e-9, atol=1e-9)
        assert np.allclose(loess._even(n, span)(y), loess.plain_smoother(n, span, np.ones((1, n)))(y), rtol=1e-9, atol=1e-9)
    x = rng.normal(size=348)
    assert np.allclose(np.correlate(x, loess._low_kernel(24)), loess._low(x, 24))


def test_decomposition_holds_rows_and_not_rows_times_neighbours():
    y = np.random.default_rng(6).exponential(50, 6000)
    loess.decompose(y, outer=0)
    tracemalloc.start()
    parts = loess.decompose(y, outer=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(sum(parts), y)
    assert peak < 6000 * 8 * 39 * 2


def test_the_order_of_sums_does_not_show_in_short_series(monkeypatch):
    """Two values a sub-series leave rounding only; the plain sums are those of the start."""
    y = np.random.default_rng(7).exponential(50, 400)
    monkeypatch.setattr(loess, "smoother", None)
    assert np.allclose(sum(loess.decompose(y[:48])), y[:48])
    monkeypatch.undo()
    short = [loess.decompose(y[:n], outer=3) for n in (96, 150, 400)]
    monkeypatch.setattr(loess, "PLAIN_CYCLES", 20)
    for n, parts in zip((96, 150, 400), short):
        assert np.allclose(loess.decompose(y[:n], outer=3), parts, rtol=1e-9, atol=1e-9)


def test_residuals_fill_gaps_and_keep_rows_and_nulls(spark):
    h = np.arange(200)
    kwh = [None if i in (0, 1, 77) else float("nan") if i == 90 else float(10 + 4 * np.sin(i / 4) + i % 3) for i in h]
    rows = [("t", None, "c", "weekend", START + dt.timedelta(hours=int(i)), kwh[i]) for i in np.random.default_rng(1).permutation(200)]
    rows += [("t", "b", "none", None, START + dt.timedelta(hours=i), None) for i in range(50)] + [("t", "b", "undated", "weekend", None, 1.0)] * 2
    df = spark.createDataFrame(rows, "tenant_id string, building_id string, circuit_id string, day_type string, ts timestamp, kwh double")
    got = stl.residuals(df).collect()
    assert len(got) == 252
    long = sorted((r for r in got if r.circuit_id == "c"), key=lambda r: r.ts)
    filled = [kwh[2], kwh[2], *kwh[2:77], kwh[76], *kwh[78:90], kwh[89], *kwh[91:]]
    assert np.allclose([r.stl_trend + r.stl_seasonal + r.stl_residual for r in long], filled)
    assert [i for i, r in enumerate(long) if r.kwh is None] == [0, 1, 77, 90] and all(r.building_id is None and not r.low_data_quality and r.low_data_quality_reason is None for r in long)
    assert all(r.low_data_quality and r.stl_trend is None and r.is_anomalous is None and "only NaN" in r.low_data_quality_reason for r in got if r.circuit_id == "none")
    assert [(r.kwh, r.ts) for r in got if r.circuit_id == "undated"] == [(1.0, None)] * 2


def test_features_work_out_their_readings_once(spark, sf_dir, tmp_path):
    """Rules, day types, gaps and rolling features read one stored table, however costly the readings behind it are."""
    rows = [("t0", "b1", "b1-view", "plug_load", START + dt.timedelta(hours=i), float(i % 24), "pass") for i in range(60)]
    source = str(tmp_path / "readings")
    spark.createDataFrame(rows, "tenant_id string, building_id string, circuit_id string, circuit_type string, ts timestamp, kwh double, data_quality_status string").write.parquet(source)
    days = spark.createDataFrame([("t0", "b1", START.date() + dt.timedelta(days=i), "business_day") for i in range(3)], "tenant_id string, building_id string, date date, day_type string")
    feats = batch_features(spark.read.parquet(source), views.buildings(spark, sf_dir), days)
    assert not [f for f in feats.inputFiles() if source in f]
    got = feats.orderBy("ts").collect()
    assert [r.kwh for r in got] == [r[5] for r in rows] and not any(r.low_data_quality for r in got)


def test_training_steps_are_those_of_the_plain_formula():
    rng = np.random.default_rng(1)
    x, shape = rng.normal(size=(70, 6)), mlp.sizes(6, (5, 4), 2)
    plain, start = mlp.linear_layers(shape, 2), mlp.init(shape, 3)
    flat, m, v, step, order = start.copy(), 0.0, 0.0, 0, np.random.default_rng(8)
    for _ in range(3):
        rows = order.permutation(len(x))
        for a in range(0, len(x), 32):
            batch, grad, step = x[rows[a : a + 32]], [], step + 1
            acts = mlp.forward(flat, shape, batch, plain)
            delta = 2 * (acts[-1] - batch) / batch.size
            for i in reversed(range(len(shape) - 1)):
                delta = delta if i in plain else delta * (acts[i + 1] > 0)
                grad = [(acts[i].T @ delta).ravel(), delta.sum(0), *grad]
                delta = delta @ mlp._views(flat, shape)[i][0].T
            g = np.concatenate(grad)
            m, v = m + 0.1 * (g - m), v + 0.001 * (g * g - v)
            flat = flat - 1e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(mlp.fit(start, shape, x, plain, 3, 32, 1e-3, 8), flat, rtol=1e-10, atol=1e-13)


def test_many_small_parts_share_folders_and_change_one_by_one(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), folders=4)
    rows = spark.range(600).select(F.concat(F.lit("t/"), (F.col("id") % 300).cast("string")).alias("k"), F.when(F.col("id") % 300 != 7, F.lit("m")).alias("m"), F.col("id").alias("v"))
    store.update("all", lambda base: [store.stage("t", rows, rows.select("k", "m"), ["k", "m"])])
    assert len(store.locations("t")) <= 4
    named = rows.filter("k in ('t/3', 't/7')").select("k", "m")
    read = lambda touched, parts: sorted(r["v"] for r in store.read("t", rows.schema, touched, parts).collect())
    assert read(named, ["k", "m"]) == read(named.select("k"), ["k"]) == [3, 7, 303, 307]

    late = store.stage("t", rows.filter("v = 4"), rows.filter("v = 4").select("k", "m"), ["k", "m"])
    base = store.version()
    change = store.stage("t", rows.filter("v = 3"), named, ["k", "m"])
    assert [r["v"] for r in change.rows.collect()] == [3]
    store.commit("two", base, [change])
    want = sorted(v for v in range(600) if v not in (303, 7, 307))
    assert read(None, []) == want
    beside = rows.join(late.entries.filter("location is not null"), F.concat(F.lit("k=t%2F"), F.expr("substring(k, 3)"), F.lit("/m="), F.coalesce("m", F.lit("__null__"))) == F.col("part"), "left_semi")
    if not beside.filter("k in ('t/3', 't/7')").isEmpty():
        with pytest.raises(Conflict):
            store.commit("late", base, [late])
    store.vacuum(older_than_ms=0)
    assert read(None, []) == want and read(named, ["k", "m"]) == [3]
    store.compact("t", rows.schema, ["k", "m"])
    assert read(None, []) == want


def _files(path):
    return sorted(str(p.parent) for p in path.rglob("*.parquet") if not p.name.startswith((".", "_")))


def test_appended_files_follow_the_parts_not_the_tasks(spark, tmp_path):
    merge.append_files(spark.range(4000).repartition(8).select((F.col("id") % 40).alias("tenant_id"), "id"), str(tmp_path / "t"))
    assert len(_files(tmp_path / "t")) == 40
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4000


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        store = SnapshotStore(spark, str(tmp_path / "store"))
        rows = spark.range(0, 200_000, 1, 8).select(F.lit("one").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        store.update("all", lambda base: [store.stage("t", rows, rows.select("k"), ["k"])])
    finally:
        spark.conf.set(key, before)
    assert len(_files(tmp_path / "store" / "data")) >= 4
    assert store.read("t", rows.schema).distinct().count() == 200_000


def test_gate_tasks_follow_the_hours_of_the_grid(spark, monkeypatch):
    """Few cells far apart make many hours: tasks are dealt by hours, and the readings stay the same."""
    hour = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, int(id div 20) * 100)"
    raw = spark.range(200).selectExpr("'t' tenant_id", "'b' building_id", "'u' batch_id", "concat('c', id % 20) circuit_id", "'hvac' circuit_type", "'csv_upload' ingestion_source", f"{hour} ts", "double(id % 7) kwh")
    batches, bounds = raw.select(*gate.BATCH).distinct(), built_in_bounds(spark)
    run = lambda: gate.quality_gate(raw, batches, bounds).readings
    one = sorted(map(str, run().collect()))
    monkeypatch.setattr(gate, "TASK_HOURS", 1000)
    cells, tasks = gate.place_cells(gate.raw_cells(raw, [*gate.KEYS, "circuit_type", "ingestion_source"]), [*gate.KEYS, "circuit_type", "ingestion_source"])
    assert tasks == cells.rdd.getNumPartitions() == 19  # 20 circuits of 901 hours
    assert sorted(map(str, run().collect())) == one and len(one) == 20 * 901


def test_a_small_file_whose_rows_multiply_is_not_broadcast_by_an_estimate(spark, tmp_path):
    configure(spark)
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "10485760b"
    spark.range(100_000).select(F.col("id").cast("string").alias("building_id"), F.lit("t").alias("tenant_id")).write.parquet(str(tmp_path / "b"))
    b = spark.read.parquet(str(tmp_path / "b"))  # under a megabyte; with a row for each salt a hundred in memory
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("building_id"), F.lit("t").alias("tenant_id"), F.col("id"))
    met = salted_join(rows.repartition(4), b, ["tenant_id", "building_id"])
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 100_000


def test_samples_move_once_to_the_task_in_which_their_trees_grow(spark):
    name = F.concat(F.lit("b"), F.floor(F.col("id") / 3000).cast("string"))
    rows = spark.range(3000).select(name.alias("tenant_id"), name.alias("building_id"), F.lit("c").alias("circuit_id"), F.timestamp_seconds("id").alias("ts"), F.array(F.col("id").cast("double")).alias("scaled"))
    cfg = ForestConfig(trees=120, sample=64)
    drawn = forest.tree_samples(rows, cfg)
    grown = drawn.groupBy("tenant_id", "building_id", "_block").applyInArrow(forest._grower(cfg), forest.TREES)
    plan = grown._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.find("Window ")] and "REPARTITION_BY_NUM" in plan[plan.find("Window ") :]
    trees = {r.tree: r for r in grown.collect()}
    assert len(trees) == 120 and all(r.size[0] == 64 for r in trees.values())
    own = sorted(r.scaled[0] for r in drawn.filter("tree = 7").collect())
    seed = int.from_bytes(b"b0", "big") + cfg.seed
    x = np.array([[r.scaled[0]] for r in drawn.filter("tree = 7").orderBy("_r").collect()])
    assert sorted(x[:, 0]) == own
    plain = one_tree(x, np.random.default_rng([seed, 7]))
    assert [list(n) for n in zip(*(trees[7][k] for k in forest.PARTS))] == plain


def test_trees_of_constant_and_single_rows_stop():
    samples = [np.ones((9, 2)), np.zeros((1, 2)), np.array([[0.0, 1.0], [0.0, 2.0]]), np.random.default_rng(0).normal(size=(40, 2))]
    grown = isolation.grow_together(samples, [np.random.default_rng([1, k]) for k in range(4)])
    assert [len(t["size"]) for t in grown[:3]] == [1, 1, 3]
    assert all([list(n) for n in zip(*t.values())] == one_tree(x, np.random.default_rng([1, k])) for k, (x, t) in enumerate(zip(samples, grown)))
