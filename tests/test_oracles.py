"""Every registered query on the whole smallest tables, against its SQL twin where it has one."""

import pytest

from wattloom.workbench import catalog
from wattloom.workbench.compare import compare, duck

ORACLES = catalog.oracles()
QUERIES = catalog.queries()


def _keys(*names):
    def unique(rows):
        keys = [tuple(r[n] for n in names) for r in rows]
        assert len(set(keys)) == len(keys) and all(k is not None for ks in keys for k in ks)

    return unique


def _all(*checks):
    return lambda rows: [c(rows) for c in checks] and None


def _between(name, low, high):
    def inside(rows):
        assert all(r[name] is None or low <= r[name] <= high for r in rows)

    return inside


# what holds for queries that SQL cannot restate: their keys, and the range of what they compute
PROPERTIES = {
    "seasonal_residuals": _keys("circuit_id", "ts"),
    "forest_training": _all(_keys("tenant_id", "building_id"), _between("offset", -1, 0), _between("train_anomaly_rate", 0, 0.5)),
    "forest_scores": _all(_keys("tenant_id", "building_id", "circuit_id", "ts"), _between("if_score", -1, 1)),
    "forest_attribution": _all(_keys("building_id", "circuit_id", "ts", "feature"), lambda rows: None),
    "window_model_training": _all(_keys("tenant_id", "building_id"), _between("train_anomaly_rate", 0, 0.06), _between("threshold", 0, 1e6)),
    "window_model_scores": _all(_keys("tenant_id", "building_id", "circuit_id", "ts"), _between("ae_reconstruction_error", 0, 1e9)),
    "confidence_fit": _keys("tenant_id", "building_id"),
    "champion_scores": _all(_keys("building_id", "circuit_id", "ts"), _between("if_score", -1, 1), _between("forest_version", 1, 2)),
    "analysis_model_findings": _all(_keys("building_id", "layer_origin"), lambda rows: [r for r in rows if r["n"] != r["n_ids"]] and pytest.fail("findings share ids")),
    "stream_retraining_triggers": _keys("dedupe_key"),
    "ensemble_findings": _all(_keys("building_id", "circuit_id", "detected_at"), _between("confidence", 0, 1), _between("n_top", 0, 5)),
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        _, diff = compare(df, con, ORACLES[name])
        assert not diff, diff
    else:
        check = PROPERTIES[name]
        rows = df.collect()
        assert rows, name
        check(rows)


def test_twins_have_queries():
    assert not ORACLES.keys() - QUERIES.keys()
