"""Streaming queries (run to the end of their input) and the batch forms of the same operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.operators import feedback
from wattloom.session import configure, shared_path
from wattloom.sinks import merge
from wattloom.sinks.snapshots import SnapshotStore
from wattloom.sources.bounds import built_in_bounds
from wattloom.streaming import events, ingest, starts
from wattloom.streaming import feedback as feedback_stream
from wattloom.workbench import gate_checks, sql, views
from wattloom.workbench.views import plain


def table_stream(spark, sf_dir, name):
    """One test table as a stream of its file."""
    schema = views.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _deliveries(spark, sf_dir):
    """Events as raw rows in three deliveries, by circuit and day: some come late and leave days empty, some come twice, some are wrong at first."""
    e = views.raw_meters(spark, sf_dir).select(*ingest.RAW)
    kind = F.pmod(F.xxhash64("circuit_id", F.to_date("ts")), F.lit(4))
    late, wrong, twice = kind == 0, kind == 1, kind == 2
    first = e.filter(~late).withColumn("kwh", F.when(wrong, F.col("kwh") * 3 + 1).otherwise(F.col("kwh")))
    return [first, e.filter(wrong | twice), e.filter(late | twice)]


def stream_meter_ingest(spark, sf_dir):
    """Deliveries streamed through the gate into a stored readings table, one micro-batch each."""
    configure(spark)
    store = ingest.Store(shared_path(spark, "ingest"), shards=4)
    source, offsets = shared_path(spark, "deliveries"), shared_path(spark, "offsets")
    for rows in _deliveries(spark, sf_dir):
        rows.write.mode("append").parquet(source)
        ingest.start_ingest(spark.readStream.schema(rows.schema).parquet(source), store, built_in_bounds(spark), offsets).awaitTermination()
    r = ingest.readings(spark, store)
    return plain(r.select("tenant_id", "circuit_id", "ts", "kwh", "filled", "data_quality_status"))


def _messages(df):
    """Events as JSON messages; every third one is delivered twice."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", events.ARRIVED).when(F.col("event_type") == "view", events.ELIGIBLE).when(F.col("event_type") == "error", events.DRIFTED).otherwise("other.event")
    body = F.to_json(F.struct(
        i.cast("string").alias("event_id"), F.concat(F.lit("t"), F.floor(F.col("user_id") / 100).cast("string")).alias("tenant_id"),
        F.concat(F.lit("b"), F.floor(F.col("user_id") / 50).cast("string")).alias("building_id"), F.concat(F.lit("c"), F.floor(i / 10).cast("string")).alias("correlation_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), kind.alias("event_type"), (i % 40).alias("feedback_count"),
    ))
    return df.select(body.alias("value"), F.explode(F.when(i % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def event_routing(spark, sf_dir):
    e = events.route(events.parse(_messages(views.table(spark, sf_dir, "events"))), events.ARRIVED)
    return e.groupBy("tenant_id", "building_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("correlation_id").alias("n_batches"))


def analysis_starts(spark, sf_dir):
    e = events.route(events.parse(_messages(views.table(spark, sf_dir, "events"))), events.ARRIVED)
    return events.once(e, "analysis").select("tenant_id", "building_id", "correlation_id", "dedupe_key")


def stream_analysis_starts(spark, sf_dir):
    """The same on a stream, with the ledger of starts."""
    configure(spark)
    store = SnapshotStore(spark, shared_path(spark, "starts"))
    e = events.route(events.parse(_messages(table_stream(spark, sf_dir, "events"))), events.ARRIVED)
    q = e.writeStream.foreachBatch(starts.starts_batch("analysis", store, 8)).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return starts.starts(store, "analysis").select("tenant_id", "building_id", "correlation_id", "dedupe_key")


def retraining_triggers(spark, sf_dir):
    parsed = events.parse(_messages(views.table(spark, sf_dir, "events")))
    f = views.findings(spark, sf_dir).groupBy("tenant_id", "building_id").agg(F.max("detected_at").alias("trained_at"))
    cal = feedback.calendar_triggers(f, F.lit("2001-10-01 00:00:00").cast("timestamp"))
    drift = events.triggers(events.route(parsed, events.DRIFTED), "drift")
    volume = events.triggers(events.route(parsed, events.ELIGIBLE), "feedback_volume")
    t = feedback.retraining_triggers(cal, drift, volume)
    return t.groupBy("tenant_id", "building_id", "trigger").agg(F.count(F.lit(1)).alias("n"))


def stream_label_counter(spark, sf_dir):
    """Labels streamed against stored findings; one row per building at its fifth label."""
    configure(spark)
    l = table_stream(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("finding_id"))
    labeled = l.join(views.findings(spark, sf_dir).select("finding_id", "tenant_id", "building_id"), "finding_id")
    out, at = shared_path(spark, "crossings"), shared_path(spark, "offsets")
    q = (
        feedback_stream.crossing_stream(labeled).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)


def stream_feedback_status(spark, sf_dir):
    """Labels streamed onto stored findings: statuses after the stream ends."""
    configure(spark)
    store = SnapshotStore(spark, shared_path(spark, "feedback"))
    f = views.findings(spark, sf_dir).withColumn("bundle", F.when(F.col("confidence").isNotNull(), "{1}"))
    feedback_stream.store_findings(store, f, "findings", 4)
    l = table_stream(spark, sf_dir, "lineitem")
    rows = l.select(
        F.concat_ws("-", F.lit("l"), *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("feedback_id"),
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("finding_id"),
        F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "dismissed").otherwise("noted").alias("action"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    ).join(f.select("finding_id", "tenant_id"), "finding_id")
    q = (
        rows.writeStream.foreachBatch(feedback_stream.apply_batch(store, f.schema, 4))
        .option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return store.read("findings", f.schema).select("finding_id", "status")


def stream_retraining_triggers(spark, sf_dir):
    """Trainings, drift events and labels as one stream: what starts a retraining, the calendar's own dates included."""
    configure(spark)
    e = table_stream(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "drift").when(F.col("event_id") % 97 == 0, "trained").when(F.col("event_id") % 5 == 0, "label")
    changes = e.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        F.concat(F.lit("t"), F.floor(F.col("user_id") / 100).cast("string")).alias("tenant_id"), F.concat(F.lit("b"), F.floor(F.col("user_id") / 50).cast("string")).alias("building_id"),
        "kind", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("name"),
    )
    out, at = shared_path(spark, "triggers"), shared_path(spark, "offsets")
    q = (
        starts.retraining_stream(changes).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(starts.TRIGGERS).parquet(out)


def late_redelivery(spark, sf_dir):
    """Hours delivered again later, whole: the last delivery wins."""
    u = views.user_meters(spark, sf_dir)
    k = ["tenant_id", "circuit_id"]
    hour = F.date_trunc("hour", "ts")
    first = u.groupBy(*k, hour.alias("ts")).agg(F.round(F.sum("kwh"), 6).alias("kwh"), F.lit("pass").alias("data_quality_status"))
    again = first.filter(F.hour("ts") % 2 == 0).withColumns({"kwh": F.col("kwh") + 1, "data_quality_status": F.lit("degraded"), "batch_seq": F.lit(1)})
    twice = again.filter(F.hour("ts") % 4 == 0).withColumns({"kwh": F.col("kwh") + 1, "batch_seq": F.lit(2)})
    return plain(merge.upsert(first, again.unionByName(twice), update=merge.READING_VALUES))


QUERIES = {
    f.__name__: f
    for f in (
        stream_meter_ingest, event_routing, analysis_starts, stream_analysis_starts, retraining_triggers, stream_label_counter, stream_feedback_status, stream_retraining_triggers, late_redelivery,
    )
}

_MSG = """msg AS (SELECT 't'||(user_id//100) AS tenant_id, 'b'||(user_id//50) AS building_id, 'c'||(event_id//10) AS correlation_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp,
    event_type, event_id % 40 AS n, event_id FROM events UNION ALL SELECT 't'||(user_id//100), 'b'||(user_id//50), 'c'||(event_id//10), strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_type, event_id % 40, event_id FROM events WHERE event_id % 3 = 0)"""
_STARTS = f"WITH {_MSG} SELECT DISTINCT tenant_id, building_id, correlation_id, 'analysis-'||tenant_id||'-'||building_id||'-'||correlation_id AS dedupe_key FROM msg WHERE event_type = 'click'"
_NO_DRIFT = gate_checks._GATE.replace("CASE WHEN CAST(substr(s.building_id, 2) AS INT) % 3 = 1 THEN 1 ELSE 0 END,", "")

ORACLES = {
    "stream_meter_ingest": f"WITH {_NO_DRIFT} SELECT tenant_id, circuit_id, ts, kwh, filled, data_quality_status FROM final",
    "event_routing": f"WITH {_MSG} SELECT tenant_id, building_id, count(*) AS n, count(DISTINCT correlation_id) AS n_batches FROM msg WHERE event_type = 'click' GROUP BY ALL",
    "analysis_starts": _STARTS,
    "stream_analysis_starts": _STARTS,
    "retraining_triggers": f"""WITH {_MSG}, {sql.FINDINGS} SELECT tenant_id, building_id, 'drift' AS trigger, count(DISTINCT stamp) AS n FROM msg WHERE event_type = 'error' GROUP BY ALL
        UNION ALL SELECT tenant_id, building_id, 'feedback_volume', count(DISTINCT n) FROM msg WHERE event_type = 'view' GROUP BY ALL
        UNION ALL SELECT tenant_id, building_id, 'calendar', 1 FROM findings GROUP BY tenant_id, building_id HAVING max(detected_at) <= TIMESTAMP '2001-10-01' - INTERVAL 30 DAY""",
    "stream_label_counter": f"WITH {sql.FINDINGS}, {sql.LABELS} SELECT tenant_id, building_id, CAST(5 AS BIGINT) AS feedback_count FROM labels_fb JOIN findings USING (finding_id) GROUP BY ALL HAVING count(*) >= 5",
    "stream_feedback_status": f"""WITH {sql.FINDINGS}, {sql.LABELS}, last AS (SELECT l.finding_id, arg_max(l.action, (created_at, feedback_id)) AS action FROM labels_fb l JOIN findings f USING (finding_id)
        WHERE l.action <> 'noted' AND f.confidence IS NOT NULL GROUP BY 1) SELECT finding_id, coalesce(action, status) AS status FROM findings LEFT JOIN last USING (finding_id)""",
    "late_redelivery": f"""WITH {sql.USERS} SELECT tenant_id, circuit_id, date_trunc('hour', ts) AS ts, round(sum(kwh), 6) + CASE WHEN hour(date_trunc('hour', ts)) % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN hour(date_trunc('hour', ts)) % 2 = 0 THEN 1 ELSE 0 END AS kwh,
        CASE WHEN hour(date_trunc('hour', ts)) % 2 = 0 THEN 'degraded' ELSE 'pass' END AS data_quality_status FROM users GROUP BY tenant_id, circuit_id, date_trunc('hour', ts)""",
}
