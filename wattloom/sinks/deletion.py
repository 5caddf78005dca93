"""Retention and erasure on stored tables, with a journal.

A run first writes what it is going to do, then deletes table by table, then writes its completion with the counts. Every step is one commit of the snapshot store that
holds the tables and the journal, and has an id of its own: a run that was cut goes on after its last finished step with the targets that it started with, and no
step counts twice. A step rewrites only the parts that hold rows to delete; `vacuum` then removes the files that the newest snapshot does not name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.scalars import iso_text
from wattloom.operators.retention import BUILDING
from wattloom.operators.skew import salted_join
from wattloom.session import store_table
from wattloom.sinks.snapshots import SnapshotStore

JOURNAL = "run string, step string, tenant_id string, building_id string, name string, n long, cutoff timestamp"
STEP = ["run", "step"]
# rows go before what identifies them
ORDER = ("feedback", "findings", "readings", "calendar", "circuits", "buildings")


@dataclass
class Stored:
    """A table of the store: its columns, and the ones that its parts are named by."""

    schema: str
    parts: Sequence[str]


def _journal(rows: DataFrame, run: str, step: str) -> DataFrame:
    have = set(rows.columns)
    kinds = dict(c.split() for c in JOURNAL.split(", "))
    fixed = {"run": F.lit(run), "step": F.lit(step)}
    return rows.select(*[fixed.get(c, F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in kinds])


def journal(store: SnapshotStore) -> DataFrame:
    return store.read("journal", JOURNAL)


def _write(store: SnapshotStore, rows: DataFrame, run: str, step: str):
    named = store.spark.createDataFrame([(run, step)], "run string, step string")
    return store.stage("journal", _journal(rows, run, step), named, STEP)


def _started(store: SnapshotStore, run: str, targets: DataFrame) -> DataFrame:
    """Puts the run's targets in the journal, once, and returns those that stand there."""
    store.update(f"{run}:start", lambda base: [_write(store, targets, run, "start")])
    named = store.spark.createDataFrame([(run, "start")], "run string, step string")
    return store.read("journal", JOURNAL, named, STEP)


def delete_rows(store: SnapshotStore, run: str, table: str, stored: Stored, hits) -> int:
    """One step: deletes the rows of a table that `hits` (DataFrame -> DataFrame, how: semi or anti) picks, and journals their numbers per building."""

    def work(base: int):
        # the scan that finds parts reads keys only; what it finds is read again whole, part by part
        found = hits(store.read(table, stored.schema, version=base), "left_semi")
        keys = [c for c in BUILDING if c in found.columns]
        touched = store_table(found.select(*stored.parts).distinct(), "hit")
        inside = store.read(table, stored.schema, touched, stored.parts, base)
        counts = hits(inside, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        rest = store.stage(table, hits(inside, "left_anti"), touched, stored.parts)
        return [rest, _write(store, counts, run, table)]

    return store.update(f"{run}:{table}", work)


def enforce_retention(store: SnapshotStore, run: str, stored: Stored, limits: DataFrame, table: str = "readings") -> DataFrame:
    """Deletes the rows of tenants with a policy that are older than its cutoff; returns the audit rows. `limits`: tenant_id, cutoff."""
    targets = _started(store, run, limits.select("tenant_id", "cutoff"))
    policy = targets.select("tenant_id", "cutoff")

    def hits(rows: DataFrame, how: str) -> DataFrame:
        judged = salted_join(rows, policy, ["tenant_id"], "left")
        old = F.coalesce(F.col("ts") < F.col("cutoff"), F.lit(False))
        return judged.filter(old if how == "left_semi" else ~old).drop("cutoff")

    delete_rows(store, run, table, stored, hits)
    store.update(f"{run}:done", lambda base: [_write(store, policy, run, "done")])
    counts = journal(store).filter((F.col("run") == run) & (F.col("step") == table)).groupBy("tenant_id").agg(F.sum("n").alias("n"))
    return policy.join(counts, "tenant_id", "left").select(
        "tenant_id", F.lit("retention.enforcement").alias("event_type"), iso_text("cutoff").alias("cutoff"), F.coalesce("n", F.lit(0)).alias("n_deleted")
    )


def erase_stored(store: SnapshotStore, run: str, tables: dict[str, Stored], targets: DataFrame, stop_after: str | None = None) -> DataFrame:
    """Deletes buildings (BUILDING) with all that hangs on them from the stored tables; returns start and completion rows. `stop_after` ends the run behind a step, as a
    lost driver would; the same call without it goes on."""
    asked = _started(store, run, salted_join(store.read("buildings", tables["buildings"].schema), targets.select(*BUILDING).distinct(), BUILDING, "left_semi").select(*BUILDING, "name"))
    t = asked.select(*BUILDING)

    def by_building(rows, how):
        return salted_join(rows, t, BUILDING, how)

    def by(table: str, *key: str):
        own = by_building(store.read(table, tables[table].schema), "left_semi").select(*BUILDING, *key).distinct()

        def hits(rows, how):
            keys = ["tenant_id", *key] if "tenant_id" in rows.columns else list(key)
            if how == "left_anti":
                return salted_join(rows, own.select(*keys).distinct(), keys, how)
            return salted_join(rows.drop("building_id"), own.select(*BUILDING, *[c for c in key]) if "tenant_id" in rows.columns else own, keys)

        return hits

    ways = {"feedback": lambda: by("findings", "finding_id"), "readings": lambda: by("circuits", "circuit_id")}
    for name in ORDER:
        if name in tables:
            if not store.done(f"{run}:{name}"):
                delete_rows(store, run, name, tables[name], ways.get(name, lambda: by_building)())
            if name == stop_after:
                break
    else:
        store.update(f"{run}:done", lambda base: [_write(store, asked.select(*BUILDING, "name"), run, "done")])
    return erasure_rows(store, run)


def erasure_rows(store: SnapshotStore, run: str) -> DataFrame:
    """The journal of a run as rows: start and completion per building, with the counts of every table in the completion."""
    own = journal(store).filter(F.col("run") == run)
    steps = [s for s in ORDER if s != "buildings"]
    counts = own.filter(F.col("step").isin(*steps)).groupBy(*BUILDING).agg(*[F.sum(F.when(F.col("step") == s, F.col("n"))).alias(f"{s}_deleted") for s in steps])
    event: Column = F.when(F.col("step") == "start", "building.data.deleted").when(F.col("step") == "done", "building.data.deletion_completed")
    rows = own.filter(F.col("step").isin("start", "done")).select(*BUILDING, "name", event.alias("event_type"))
    known = rows.join(counts, BUILDING, "left")
    done = F.col("event_type") == "building.data.deletion_completed"
    return known.select(*BUILDING, "name", "event_type", *[F.when(done, F.coalesce(f"{s}_deleted", F.lit(0))).alias(f"{s}_deleted") for s in steps])


def stored_tables(store: SnapshotStore, frames: dict[str, DataFrame], parts: dict[str, Sequence[str]]) -> dict[str, Stored]:
    """Puts tables into a store, one commit for all."""
    out = {}
    for name, df in frames.items():
        out[name] = Stored(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), parts[name])
    store.update("stored", lambda base: [store.stage(n, df, df.select(*parts[n]).distinct(), parts[n]) for n, df in frames.items()])
    return out


def file_rows(spark: SparkSession, store: SnapshotStore, table: str, schema: str) -> DataFrame:
    """All rows in any file of a table, whether or not a snapshot names it."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[
        s.getPath().toString() for s in store._fs(f"{store.root}/data")[0].listStatus(store._fs(f"{store.root}/data")[1]) if s.getPath().getName().startswith(f"{table}-")
    ])
