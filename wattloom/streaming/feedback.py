"""Continuous feedback: label application per micro-batch and the running label count."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from wattloom.config import RETRAIN_AT_LABELS
from wattloom.operators.feedback import accepted, apply_status, judge
from wattloom.session import store_table
from wattloom.sinks.merge import last_per_key
from wattloom.sinks.snapshots import SnapshotStore

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CROSSINGS = "tenant_id string, building_id string, feedback_count long"


class LabelCounter(StatefulProcessor):
    """One number per building; a row leaves when the count passes through the threshold."""

    def __init__(self, at: int = RETRAIN_AT_LABELS) -> None:
        self._at = at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        before = self._count.get()[0] if self._count.exists() else 0
        after = before + sum(int(part["n"].sum()) for part in rows)
        self._count.update((after,))
        if before < self._at <= after:
            yield pd.DataFrame({"tenant_id": [key[0]], "building_id": [key[1]], "feedback_count": [self._at]})

    def close(self) -> None:
        pass


def crossing_stream(labeled: DataFrame, at: int = RETRAIN_AT_LABELS) -> DataFrame:
    """Stream of (building, count) rows, one per building when it reaches the threshold."""
    labeled.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return (
        labeled.select("tenant_id", "building_id", F.lit(1).cast("long").alias("n"))
        .groupBy("tenant_id", "building_id")
        .transformWithStateInPandas(LabelCounter(at), outputStructType=CROSSINGS, outputMode="Append", timeMode="None")
    )


PARTS = ["tenant_id", "bucket"]


def with_bucket(df: DataFrame, buckets: int = 64) -> DataFrame:
    """With the part that a finding, and all of its labels, lie in."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("finding_id"), F.lit(buckets)).cast("int"))


def store_findings(store: SnapshotStore, findings: DataFrame, commit_id: str, buckets: int = 64) -> int:
    """Puts findings into the store, in place of all in the parts that they lie in."""
    rows = with_bucket(findings, buckets)
    return store.update(commit_id, lambda base: [store.stage("findings", rows, rows.select(*PARTS).distinct(), PARTS)])


def apply_labels(batch: DataFrame, store: SnapshotStore, schema: StructType, commit_id: str, buckets: int = 64) -> int:
    """Valid labels are stored and set their finding's status; the rest is kept with the reason. Labels, findings and rejections change in one commit, and only the
    parts that the labels' findings lie in are read. A finding has the action of its latest label, whichever delivery brought it."""
    stored = StructType([*schema.fields, StructField("bucket", IntegerType())])

    def work(base: int):
        own = store_table(with_bucket(batch, buckets), "labels")
        touched = own.select(*PARTS).distinct()
        findings = store.read("findings", stored, touched, PARTS, base)
        judged = store_table(judge(own, findings), "judged")
        good = accepted(judged)
        known = store.read("labels", good.schema, touched, PARTS, base)
        # a label that comes again takes the place of the one before
        kept = known.join(good.select("tenant_id", "feedback_id"), ["tenant_id", "feedback_id"], "left_anti")
        labels = store.stage("labels", kept.unionByName(last_per_key(good, ["tenant_id", "feedback_id"], ["created_at"]).select(*good.columns)), touched, PARTS)
        bad = judged.filter(F.col("rejection").isNotNull()).withColumn("delivery", F.lit(commit_id))
        named = store.spark.createDataFrame([(commit_id,)], "delivery string")
        return [labels, store.stage("findings", apply_status(findings, labels.rows), touched, PARTS), store.stage("rejected", bad, named, ["delivery"])]

    return store.update(commit_id, work)


def apply_batch(store: SnapshotStore, schema: StructType, buckets: int = 64, stream: str | None = None):
    """Function for `foreachBatch`; `schema` is the findings'."""

    def run(batch: DataFrame, seq: int) -> None:
        name = stream or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not name:
            raise ValueError("a delivery outside of a streaming query needs the name of its stream")
        if not batch.isEmpty():
            apply_labels(batch, store, schema, f"{name}#{seq}", buckets)

    return run
