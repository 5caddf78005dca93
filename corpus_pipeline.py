"""The corpus pipeline: documents through its stages, each written as Parquet and read again as the next one's documents.

Every stage takes all documents that its predecessor kept and returns rows with the columns of documents, but for the last, which returns what it wrote.

A stage sees the columns that it works on (doc_id, text and, for mixing, source) and all others as one struct, so columns of any name come through unchanged.
Null or empty texts: hold nothing toxic and no benchmark item, so both stages keep them; the Jaccard join links them with nothing and keeps them; they have no words, so the mix takes
them as often as it takes whole rounds of their source; their token ids are the end id alone. Rows that repeat in whole, id and text, are one document to the Jaccard join
and stand as often as they come elsewhere. A null doc_id comes last among equals, a null source is a source. Ties are broken as the operators say. An empty table stays empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import decontaminate, jaccard, language, mixing, tokens, toxicity
from wattloom.llm.common import drop_tables, packed, recorded, settle, table, unpacked

NEEDED = ("doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model, learned from the labels of these documents, predicts toxic."""
    labels = table(spark, sf_dir, "labels").filter(~language.held_out(F.col("doc_id"), 4, 2))
    scored = toxicity.score(packed(docs, NEEDED), toxicity.learn(docs.select(*NEEDED), labels))
    return scored.filter(F.col("predicted") == 0).select(*unpacked(docs.columns, NEEDED))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: the one with the smallest id."""
    return jaccard.one_of_each(packed(docs, NEEDED)).select(*unpacked(docs.columns, NEEDED))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    judged = decontaminate.decontaminate(packed(docs, NEEDED), table(spark, sf_dir, "benchmark"))
    return judged.filter(~F.col("contaminated")).select(*unpacked(docs.columns, NEEDED))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's share takes them."""
    needed = (*NEEDED, "source")
    return mixing.mixed_documents(packed(docs, needed)).select(*unpacked(docs.columns, needed))


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the mix, read back from the token files."""
    return tokens.read_digests(tokens.write_tokens(docs))


_BEFORE: list[str] = []  # working tables of the stage before


def _stage(work: Callable) -> Callable:
    """A stage that first deletes the working tables of the one before: what that stage returned has been written by then."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _BEFORE)
        with recorded() as paths:
            out = work(spark, docs, sf_dir)
        _BEFORE.extend(paths)
        return out

    return run_stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("n-gram Jaccard join", _stage(one_of_each)),
    ("benchmark decontamination", _stage(drop_leaks)),
    ("mixing", _stage(mix_to_weights)),
    ("token ids", _stage(write_ids)),
]

# SQL cannot express the toxicity model, the alignment and the encoder; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
