"""Continuous meter ingest.

Raw rows are kept once per (tenant, circuit, stamp): the latest delivery of a stamp takes the place of earlier ones, whether it repeats or corrects
them. Deliveries are numbered by their arrival in the store and known by (stream, epoch): one that runs again changes nothing, and streams do not
get in each other's way. The stored readings equal the gate over all raw rows, however they were cut into batches.

A batch reads and writes only what it can change. A raw row changes hours around it: the fill of the gap it lies in, the spread of the next values, a run of
equal values, a reporting gap. All of that ends some values away, except three things: a run of equal values or a gap may be longer, but whether an hour lies in
a long enough one shows within that many values; and the share of filled hours counts for a whole building. So every touched circuit gets a window of raw days with
enough values on both sides of what changed (a wider one where gaps leave too few, up to all that the circuit has), the gate runs on the windows, and the hours
in the middle of each replace the stored ones. Sums for the share of filled hours are kept per series and meet the readings when these are read.

Raw rows, readings and sums are tables of one snapshot store, cut by a hash of the building and by day, and change together.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattloom.config import GateConfig
from wattloom.functions.scalars import rank_status, status_rank
from wattloom.operators.gate import normalize_rows, quality_gate, raw_stamps
from wattloom.operators.skew import salted_join
from wattloom.session import store_table
from wattloom.sinks.snapshots import SnapshotStore
from wattloom.sources.meters import push_rows
from wattloom.sources.presets import preset, resolve_columns

RAW = ("tenant_id", "building_id", "circuit_id", "circuit_type", "ingestion_source", "ts", "kwh")
BUILDING = ["tenant_id", "building_id"]
CIRCUIT = [*BUILDING, "circuit_id"]
SERIES = [*CIRCUIT, "circuit_type", "ingestion_source"]
KEY = [*CIRCUIT, "kind"]  # a series, with its type and source as one text that is never null
PARTS = ["shard", "day"]
RAW_TABLE = (
    "tenant_id string, building_id string, circuit_id string, circuit_type string, ingestion_source string, ts timestamp, kwh double, shard int, day date, arrived long"
)
READINGS_TABLE = (
    "tenant_id string, building_id string, batch_id string, circuit_id string, circuit_type string, ts timestamp, kwh double, is_peak_hour boolean, filled boolean, "
    "data_quality_status string, schema_version string, source_system string, normalization_version string, shard int, day date"
)
SERIES_TABLE = (
    "tenant_id string, building_id string, circuit_id string, circuit_type string, ingestion_source string, first timestamp, last timestamp, "
    "raw_rows long, valued long, shard int"
)
HOUR = "interval 1 hour"


@dataclass
class Store:
    root: str
    shards: int = 64

    def snapshots(self, spark: SparkSession) -> SnapshotStore:
        return SnapshotStore(spark, self.root)


@dataclass(frozen=True)
class Reach:
    """How far a changed hour acts, in values of its series."""

    run: int  # values in which a run of equal ones shows whether it is long enough
    frame: int  # values of the outlier frame

    @classmethod
    def of(cls, cfg: GateConfig) -> Reach:
        rules = [*cfg.stuck_rules.values(), cfg.stuck_default]
        # values lie an hour apart at least, so a run over this many of them has lasted long enough
        return cls(max(r.window for r in rules) + max(r.hours for r in rules) + 1, cfg.outlier_window)

    @property
    def before(self) -> int:
        return self.run

    @property
    def after(self) -> int:
        return self.run + self.frame

    @property
    def context(self) -> int:
        """Values beyond the replaced hours that the gate must see to be right inside them."""
        return self.run + self.frame


def payload_stream(stream: DataFrame, zone: str = "UTC") -> DataFrame:
    """Stream of push payloads (tenant_id, building_id, value) to typed raw rows."""
    rows = resolve_columns(push_rows(stream), preset("default"))
    return normalize_rows(rows.withColumns({"source_timezone": F.lit(zone), "ingestion_source": F.lit("smart_meter_api")})).select(*RAW)


def _placed(df: DataFrame, store: Store) -> DataFrame:
    """With the part that a row lies in."""
    return df.withColumns({"shard": F.pmod(F.xxhash64("building_id"), F.lit(store.shards)).cast("int"), "day": F.to_date("ts")})


def _kind() -> Column:
    return F.to_json(F.struct("circuit_type", "ingestion_source"))


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per stamp all rows of the latest delivery."""
    stamp = Window.partitionBy("tenant_id", "circuit_id", "ts")
    both = old.unionByName(new).withColumn("_last", F.max("arrived").over(stamp))
    return both.filter(F.col("_last") == F.col("arrived")).drop("_last")


def _extents(series: DataFrame, raw: DataFrame) -> DataFrame:
    """First and last raw stamp of every series, wide enough for old and new rows."""
    new = raw.groupBy(*SERIES, "shard").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    both = series.select(*SERIES, "shard", "first", "last").unionByName(new)
    return both.groupBy(*SERIES, "shard").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def _pieces(touched: DataFrame, apart: int) -> DataFrame:
    """Changed stretches (lo, hi) of circuits; days further apart than `apart` make a new stretch."""
    days = touched.groupBy(*CIRCUIT, "shard", "day").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    order = Window.partitionBy(*CIRCUIT).orderBy("day")
    far = F.coalesce(F.datediff("day", F.lag("day").over(order)) > apart, F.lit(True))
    numbered = days.withColumn("piece", F.sum(far.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*CIRCUIT, "shard", "piece").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


class _Rows:
    """Raw rows of any days as they are after the batch: merged ones where it changed a part, stored ones elsewhere."""

    def __init__(self, snapshots: SnapshotStore, base: int, merged: DataFrame, changed: DataFrame):
        self.snapshots, self.base, self.merged, self.changed = snapshots, base, merged, changed

    def of(self, windows: DataFrame) -> DataFrame:
        """Rows of the windows (CIRCUIT, shard, piece, from_day, to_day), with their piece."""
        days = windows.select("shard", F.explode(F.sequence("from_day", "to_day")).alias("day")).distinct()
        stored = self.snapshots.read("raw", RAW_TABLE, days.join(self.changed, PARTS, "left_anti"), PARTS, self.base)
        rows = stored.unionByName(self.merged)
        keep = windows.select(*CIRCUIT, "piece", "from_day", "to_day")
        return rows.join(keep, CIRCUIT).filter(F.col("day").between(F.col("from_day"), F.col("to_day")))


def _windows(pieces: DataFrame, extents: DataFrame, changed_series: DataFrame, rows: _Rows, reach: Reach) -> DataFrame:
    """Every piece with the raw days that it needs (from_day, to_day) and the hours that it replaces (left, right)."""
    whole = extents.groupBy(*CIRCUIT).agg(F.to_date(F.min("first")).alias("first_day"), F.to_date(F.max("last")).alias("last_day"))
    pieces = store_table(pieces.join(whole, CIRCUIT), "pieces")
    ends = extents.select(*CIRCUIT, _kind().alias("kind"), "shard", "first", "last")
    known = store_table(ends.join(changed_series.withColumn("changed", F.lit(True)), KEY, "left"), "extents")
    out, days = None, 2 + -(-(reach.after + reach.context) // 24)
    while True:
        windows = pieces.withColumns(
            {"from_day": F.greatest("first_day", F.date_sub(F.to_date("lo"), days)), "to_day": F.least("last_day", F.date_add(F.to_date("hi"), days))}
        )
        key = [*CIRCUIT, "piece"]
        hours = rows.of(windows).filter(F.col("kwh").isNotNull()).groupBy(*key, _kind().alias("kind")).agg(
            F.array_sort(F.collect_set(F.date_trunc("hour", "ts"))).alias("hours")
        )
        # all series of the pieces' circuits, also those without a value in the window
        seen = windows.join(known, [*CIRCUIT, "shard"]).join(hours, [*key, "kind"], "left")
        seen = seen.withColumn("hours", F.coalesce("hours", F.array().cast("array<timestamp>")))
        before = F.reverse(F.filter("hours", lambda h: h < F.col("lo")))
        after = F.filter("hours", lambda h: h > F.col("hi"))
        start, end = F.col("from_day").cast("timestamp"), F.date_add("to_day", 1).cast("timestamp") - F.expr(HOUR)
        seen = seen.withColumns(
            {
                "all_before": F.col("first") >= start, "all_after": F.col("last") < end + F.expr(HOUR),
                "_left": F.coalesce(F.try_element_at(before, F.lit(reach.before)), start), "_right": F.coalesce(F.try_element_at(after, F.lit(reach.after)), end),
                "_short": (F.size(before) < reach.before) & ~(F.col("first") >= start) | (F.size(after) < reach.after) & ~(F.col("last") < end + F.expr(HOUR)),
            }
        )
        of_piece = Window.partitionBy(*key)
        seen = seen.withColumns(
            {"left": F.min(F.when(F.col("changed"), F.col("_left"))).over(of_piece), "right": F.max(F.when(F.col("changed"), F.col("_right"))).over(of_piece)}
        )
        # a series that has rows among the replaced hours must be right there, too
        within = (F.col("first") <= F.col("right") + F.expr(HOUR)) & (F.col("last") >= F.col("left"))
        few = (F.size(F.filter("hours", lambda h: h < F.col("left"))) < reach.context) & ~F.col("all_before") | (
            F.size(F.filter("hours", lambda h: h > F.col("right"))) < reach.context
        ) & ~F.col("all_after")
        short = F.max(F.coalesce(F.col("changed"), F.lit(False)) & F.col("_short") | within & few).alias("short")
        judged = store_table(seen.groupBy(*key, "shard", "lo", "hi", "first_day", "last_day", "from_day", "to_day", "left", "right").agg(short), "windows")
        done = judged.filter("not short").drop("short")
        out = done if out is None else out.unionByName(done)
        pieces = judged.filter("short").select(*pieces.columns)
        if pieces.isEmpty():
            return out
        days *= 4


def _own_readings(rows: DataFrame, windows: DataFrame, bounds: DataFrame, cfg: GateConfig, store: Store) -> DataFrame:
    """Gate output inside the replaced hours; the share of filled hours stays out, it belongs to whole buildings."""
    named = rows.select(*RAW, F.col("piece").cast("string").alias("batch_id"))
    batches = named.select(*BUILDING, "batch_id").distinct()
    found = quality_gate(named, batches, bounds, None, replace(cfg, max_fill_ratio=float("inf"))).readings
    ranges = windows.select(*CIRCUIT, F.col("piece").cast("string").alias("batch_id"), "left", "right")
    inside = found.join(ranges, [*CIRCUIT, "batch_id"]).filter(F.col("ts").between(F.col("left"), F.col("right")))
    inside = inside.withColumn("batch_id", F.concat(F.lit("u-"), F.col("building_id"))).drop("left", "right")
    # windows of one circuit may meet; an hour that lies in two of them is the same in both
    return _placed(inside.dropDuplicates([*CIRCUIT, "circuit_type", "source_system", "ts"]), store)


def ingest(own: DataFrame, store: Store, commit_id: str, bounds: DataFrame, cfg: GateConfig = GateConfig()) -> int:
    """Takes typed raw rows of one delivery into the store; returns the version in which they are."""
    if cfg.legacy_grid:
        raise ValueError("a last hour on the hour cannot be dropped before the next delivery")
    snapshots, reach = store.snapshots(own.sparkSession), Reach.of(cfg)
    own = raw_stamps(own)
    if own.isEmpty():
        return snapshots.version()

    def work(base: int):
        new = store_table(_placed(own.select(*RAW), store).withColumn("arrived", F.lit(base + 1).cast("long")), "delivery")
        changed = new.select(*PARTS).distinct()
        old = snapshots.read("raw", RAW_TABLE, changed, PARTS, base)
        raw = snapshots.stage("raw", _merged(old, new), changed, PARTS)
        replaced = old.join(new.select("tenant_id", "circuit_id", "ts").distinct(), ["tenant_id", "circuit_id", "ts"], "left_semi")
        hits = new.select(*SERIES, *PARTS, F.date_trunc("hour", "ts").alias("hour")).unionByName(replaced.select(*SERIES, *PARTS, F.date_trunc("hour", "ts").alias("hour")))
        hits = store_table(hits.groupBy(*SERIES, *PARTS).agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")), "hits")
        ends = hits.select(*CIRCUIT, *PARTS, F.explode(F.array("lo", "hi")).alias("hour"))

        shards = hits.select("shard").distinct()
        series = snapshots.read("series", SERIES_TABLE, shards, ["shard"], base)
        extents = _extents(series, new)
        rows = _Rows(snapshots, base, raw.rows, changed)
        pieces = _pieces(ends, 4 * (reach.after + reach.context) // 24)
        windows = _windows(pieces, extents, hits.select(*CIRCUIT, _kind().alias("kind")).distinct(), rows, reach)

        fresh = store_table(_own_readings(rows.of(windows), windows, bounds, cfg, store), "readings")
        days = windows.select("shard", F.explode(F.sequence(F.to_date("left"), F.to_date("right"))).alias("day")).distinct()
        touched = days.unionByName(fresh.select(*PARTS)).distinct()
        before = snapshots.read("readings", READINGS_TABLE, touched, PARTS, base)
        ranges = windows.select(*[F.col(c).alias(f"_{c}") for c in CIRCUIT], "left", "right")
        test = F.col("ts").between(F.col("left"), F.col("right"))
        for c in CIRCUIT:
            test = test & (F.col(c) == F.col(f"_{c}"))
        gone = before.join(ranges, test, "left_semi")
        readings = snapshots.stage("readings", before.join(ranges, test, "left_anti").unionByName(fresh.select(*before.columns)), touched, PARTS)

        keyed = [*SERIES, "shard"]
        valued = lambda df, sign: df.withColumnRenamed("source_system", "ingestion_source").groupBy(*keyed).agg((sign * F.count("kwh")).alias("valued"))
        held = lambda df, sign: df.groupBy(*keyed).agg((sign * F.count(F.lit(1))).alias("raw_rows"))
        deltas = [valued(gone, -1), valued(fresh, 1), held(old, -1), held(raw.rows, 1)]
        every = extents.select(*keyed, "first", "last").unionByName(series.select(*keyed, "raw_rows", "valued"), allowMissingColumns=True)
        for d in deltas:
            every = every.unionByName(d, allowMissingColumns=True)
        sums = [F.min("first").alias("first"), F.max("last").alias("last"), F.sum("raw_rows").alias("raw_rows"), F.sum("valued").alias("valued")]
        state = every.groupBy(*keyed).agg(*sums).select(*SERIES, "first", "last", "raw_rows", "valued", "shard").fillna(0, ["raw_rows", "valued"])
        return [raw, readings, snapshots.stage("series", state, shards, ["shard"])]

    return snapshots.update(commit_id, work)


def readings(spark: SparkSession, store: Store, cfg: GateConfig = GateConfig(), version: int | None = None) -> DataFrame:
    """The stored readings of a version: those of buildings with too many filled hours are degraded at least."""
    snapshots = store.snapshots(spark)
    version = snapshots.version() if version is None else version
    rows = snapshots.read("readings", READINGS_TABLE, version=version)
    series = snapshots.read("series", SERIES_TABLE, version=version)
    filled = series.groupBy(*BUILDING).agg(
        F.sum(F.greatest(F.col("valued") - F.col("raw_rows"), F.lit(0))).alias("_filled"), F.sum("valued").alias("_valued")
    )
    worse = filled.filter(F.try_divide("_filled", "_valued") > cfg.max_fill_ratio).select(*BUILDING, F.lit(1).alias("_rank"))
    rank = F.greatest(status_rank("data_quality_status"), F.coalesce("_rank", F.lit(0)))
    return salted_join(rows, worse, BUILDING, "left").withColumn("data_quality_status", rank_status(rank)).drop("_rank", *PARTS)


def ingest_batch(store: Store, bounds: DataFrame, cfg: GateConfig = GateConfig(), stream: str | None = None):
    """Function for `foreachBatch`. Deliveries are known by the stream's id, which its checkpoint holds, and their epoch; `stream` names them otherwise."""

    def run(batch: DataFrame, seq: int) -> None:
        name = stream or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not name:
            raise ValueError("a delivery outside of a streaming query needs the name of its stream")
        ingest(batch, store, f"{name}#{seq}", bounds, cfg)

    return run


def start_ingest(stream: DataFrame, store: Store, bounds: DataFrame, checkpoint: str, cfg: GateConfig = GateConfig()) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(ingest_batch(store, bounds, cfg))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
