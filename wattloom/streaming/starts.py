"""Starts that happen once: a ledger of keys for deliveries that may repeat at any time, and retraining triggers with timers.

The ledger is a table of the snapshot store that also takes the started runs; keys and starts of a micro-batch are one commit under the stream's id and epoch. A repeat is recognised after any
time and after any restart, a batch that runs again starts nothing twice, and only the buckets that a batch's keys fall into are read. A bucket gets a file per
commit; when there are many, the next commit merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wattloom.config import RETRAIN_AT_LABELS, RETRAIN_EVERY_DAYS
from wattloom.session import store_table
from wattloom.sinks.snapshots import SnapshotStore
from wattloom.streaming.events import run_key
from wattloom.streaming.feedback import PROVIDER

LEDGER = "dedupe_key string, kind string, tenant_id string, building_id string, correlation_id string, bucket int, delivery string"
PARTS = ["bucket", "delivery"]
MERGE_AFTER = 16


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("dedupe_key"), F.lit(buckets)).cast("int")


def take_starts(events: DataFrame, kind: str, store: SnapshotStore, commit_id: str, buckets: int = 64) -> int:
    """Adds the runs that these events start to the ledger, each key once ever."""

    def work(base: int):
        keyed = events.withColumn("dedupe_key", run_key(kind)).dropDuplicates(["dedupe_key"])
        asked = keyed.select("dedupe_key", F.lit(kind).alias("kind"), "tenant_id", "building_id", "correlation_id", _bucket(buckets).alias("bucket"), F.lit(commit_id).alias("delivery"))
        asked = store_table(asked, "asked")
        known = store.read("ledger", LEDGER, asked, ["bucket"], base)
        new = asked.join(known.select("dedupe_key"), "dedupe_key", "left_anti").select(*asked.columns)
        many = known.groupBy("bucket").agg(F.countDistinct("delivery").alias("_n")).filter(F.col("_n") >= MERGE_AFTER).select("bucket")
        merged = known.join(many, "bucket", "left_semi").select(*asked.columns)
        rows = new.unionByName(merged.withColumn("delivery", F.lit(commit_id)))
        return [store.stage("ledger", rows, merged.select(*PARTS).unionByName(rows.select(*PARTS)), PARTS)]

    return store.update(commit_id, work)


def starts_batch(kind: str, store: SnapshotStore, buckets: int = 64, stream: str | None = None):
    """Function for `foreachBatch`."""

    def run(batch: DataFrame, seq: int) -> None:
        name = stream or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not name:
            raise ValueError("a delivery outside of a streaming query needs the name of its stream")
        if not batch.isEmpty():
            take_starts(batch, kind, store, f"{name}#{seq}", buckets)

    return run


def starts(store: SnapshotStore, kind: str | None = None) -> DataFrame:
    """All runs that were started."""
    rows = store.read("ledger", LEDGER).drop(*PARTS)
    return rows if kind is None else rows.filter(F.col("kind") == kind)


# --- retraining ----------------------------------------------------------------------------------
TRIGGERS = "tenant_id string, building_id string, trigger string, at timestamp, dedupe_key string"
DAY_MS = 86_400_000


class Retraining(StatefulProcessor):
    """One building's retraining triggers in event time.

    A training sets a timer that many days ahead; when the watermark passes it without another training, a calendar trigger leaves and the timer is set again. A drift event
    triggers at once, each stamp once until the next training; labels are counted from one training to the next and trigger when their number reaches the threshold.
    """

    def __init__(self, days: int = RETRAIN_EVERY_DAYS, at: int = RETRAIN_AT_LABELS) -> None:
        self._days, self._at = days, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._due = handle.getValueState("due", "at long")
        self._labels = handle.getValueState("labels", "n long")
        self._drifts = handle.getMapState("drifts", "stamp string", "seen boolean")

    def _set(self, at: int) -> None:
        if self._due.exists():
            self._handle.deleteTimer(self._due.get()[0])
        self._due.update((at,))
        self._handle.registerTimer(at)

    @staticmethod
    def _rows(key, found: list[tuple]) -> pd.DataFrame:
        kinds, ats, names = zip(*found)
        stamps = [pd.Timestamp(at, unit="ms") for at in ats]
        keys = [f"retraining-{kind}-{key[0]}-{key[1]}-{name}" for kind, name in zip(kinds, names)]
        return pd.DataFrame({"tenant_id": key[0], "building_id": key[1], "trigger": kinds, "at": stamps, "dedupe_key": keys})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The state is read before the rows and written behind them: calls to the store follow what stays, not the number of rows."""
        parts = pd.concat(list(rows)).sort_values(["ts", "kind", "name"], kind="stable")
        due = before = self._due.get()[0] if self._due.exists() else None
        counted = n = self._labels.get()[0] if self._labels.exists() else 0
        empty, cleared = not self._drifts.exists(), False
        fresh, known, found = {}, set(), []
        for kind, ts, name in zip(parts["kind"], parts["ts"], parts["name"]):
            at = int(pd.Timestamp(ts).timestamp() * 1000)
            if kind == "trained":
                # a training that comes late does not bring a newer one's date forward
                if due is None or at + self._days * DAY_MS > due:
                    due, n = at + self._days * DAY_MS, 0
                    empty = cleared = True
                    fresh.clear()
                    known.clear()
            elif kind == "drift":
                if name in fresh or name in known:
                    continue
                if not empty and self._drifts.containsKey((name,)):
                    known.add(name)
                    continue
                fresh[name] = True
                found.append(("drift", at, name))
            else:
                n += 1
                if n == self._at:
                    found.append(("feedback_volume", at, name))
        if due != before:
            self._set(due)
        if n != counted:
            self._labels.update((n,))
        if cleared:
            self._drifts.clear()
        for name in fresh:
            self._drifts.updateValue((name,), (True,))
        if found:
            yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self._due.exists() and self._due.get()[0] == at:
            due = at + self._days * DAY_MS
            self._due.update((due,))
            self._handle.registerTimer(due)
            yield self._rows(key, [("calendar", at, str(at))])

    def close(self) -> None:
        pass


def retraining_stream(changes: DataFrame, delay: str = "1 day") -> DataFrame:
    """Triggers from one stream of (tenant_id, building_id, kind: trained, drift or label, ts, name)."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return (
        changes.withWatermark("ts", delay)
        .groupBy("tenant_id", "building_id")
        .transformWithStateInPandas(Retraining(), outputStructType=TRIGGERS, outputMode="Append", timeMode="EventTime")
    )
