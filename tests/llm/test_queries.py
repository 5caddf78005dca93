"""The registered queries on the whole smallest tables: SQL twins where there are some, and the pipeline against its stages' own rules."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wattloom.llm import decontaminate, jaccard, language, mixing, toxicity
from wattloom.llm.common import settle, table
from wattloom.llm.queries import ORACLES, QUERIES
from wattloom.workbench.compare import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, sf_dir, name):
    _, diff = compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLES[name])
    assert not diff, diff


ROWS = {f"op{n}": {7: "embeddings", 11: "conversations"}.get(n, "documents") for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_tables(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    t = table(spark, sf_dir, ROWS[name.split("_")[0]])
    key = next(k for k in ("query_id", "doc_id", "conv_id") if k in df.columns)
    if key == "conv_id":
        assert df.filter("depth = 0").first()["n_convs"] == t.select("conv_id").distinct().count()
        return
    ids = {r[0] for r in df.select(key).distinct().collect()}
    want = {r[0] for r in (t.filter("vec_id % 50 = 0").select("vec_id") if key == "query_id" else t.select("doc_id")).collect()}
    assert ids == want
    if key == "doc_id":
        assert df.count() == t.count()


def test_contract_columns(spark, sf_dir):
    want = {
        "op1_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
        "op3_tokens": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        "op4_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op5_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
        "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op7_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
        "op9_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
        "op10_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
        "op11_tries": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
        "op12_merkle": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
        "op13_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    }
    for name, columns in want.items():
        have = dict(QUERIES[name](spark, sf_dir).dtypes)
        assert all(have.get(c.split()[0]) == c.split()[1] for c in columns.split(", ")), (name, have)


def test_pipeline_stages(spark, sf_dir):
    """Each stage's decisions, on its own input."""
    docs = table(spark, sf_dir, "documents")
    before, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = settle(stage(spark, before, sf_dir), "test-stage")
        if name != "token ids":
            assert after.columns == names
        had, has = before.select("doc_id", "text").collect(), after.collect()
        if name == "toxicity":
            labels = table(spark, sf_dir, "labels").filter(~language.held_out(F.col("doc_id"), 4, 2))
            kept = toxicity.score(before, toxicity.learn(before, labels)).filter("predicted = 0")
            assert sorted(r["doc_id"] for r in has) == sorted(r["doc_id"] for r in kept.collect())
        elif name == "n-gram Jaccard join":
            pairs = [tuple(r) for r in had]
            assert sorted(r["doc_id"] for r in has) == sorted({c for _, _, c in brute.components(pairs)})
        elif name == "benchmark decontamination":
            dropped = {r["doc_id"] for r in had} - {r["doc_id"] for r in has}
            leaks = {r["doc_id"] for r in had for i in table(spark, sf_dir, "benchmark").collect() if i["text"] in r["text"]}
            assert leaks <= dropped and len(dropped) <= len(leaks) + 0.02 * len(had)
        elif name == "mixing":
            taken = mixing.mix(mixing.with_keys(before)).collect()
            assert sorted(r["doc_id"] for r in has) == sorted(r["doc_id"] for r in taken for _ in range(r["copies"]))
        else:
            assert sorted(r["doc_id"] for r in has) == sorted(r["doc_id"] for r in had)
        before = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing", "token ids"]
    assert decontaminate.THRESHOLD and jaccard.N == 5
