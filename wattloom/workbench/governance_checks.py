"""Feedback, promotion, rollback, retention and erasure queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.config import ConfidenceConfig, RollbackConfig
from wattloom.operators import feedback, governance, retention
from wattloom.sinks import messages
from wattloom.workbench import feature_checks, sql, views
from wattloom.workbench.views import plain

def _end():
    return F.lit("2001-01-01 00:00:00").cast("timestamp")


WIDE = RollbackConfig(days=1500)


def false_positive_rates(spark, sf_dir):
    r = governance.false_positive_rates(views.labels(spark, sf_dir), views.findings(spark, sf_dir), *governance.rollback_window(_end(), WIDE))
    return r.select("building_id", "n_confirmed", "n_dismissed", F.round("false_positive_rate", 6).alias("false_positive_rate"))


def feedback_counts(spark, sf_dir):
    return feedback.counts(views.labels(spark, sf_dir), views.findings(spark, sf_dir))


def _labels(spark, sf_dir):
    """Labels with a tenant, some of it wrong, and findings of which some have no bundle."""
    f = views.findings(spark, sf_dir).withColumn("bundle", F.when(F.col("confidence").isNotNull(), F.concat(F.lit('{"c":'), F.col("confidence").cast("string"), F.lit("}"))))
    own = views.labels(spark, sf_dir).join(f.select("finding_id", "tenant_id"), "finding_id")
    lost = F.col("feedback_id").endswith("7")
    return own.withColumn("tenant_id", F.when(lost, "nobody").otherwise(F.col("tenant_id"))), f


def feedback_validation(spark, sf_dir):
    l, f = _labels(spark, sf_dir)
    return feedback.judge(l, f).select("feedback_id", F.regexp_replace("rejection", "f[0-9]+", "*").alias("rejection"))


def feedback_status(spark, sf_dir):
    l, f = _labels(spark, sf_dir)
    ok = feedback.accepted(feedback.judge(l, f))
    return feedback.apply_status(f, ok.drop("building_id")).select("finding_id", "status")


def _labeled(spark, sf_dir):
    return feedback.labeled_findings(views.labels(spark, sf_dir), views.findings(spark, sf_dir))


def threshold_crossings(spark, sf_dir):
    return plain(feedback.threshold_crossings(_labeled(spark, sf_dir)).select("building_id", "feedback_id", "created_at"))


def retraining_events(spark, sf_dir):
    return messages.retraining_eligible(feedback.threshold_crossings(_labeled(spark, sf_dir)))


def calibration_sets(spark, sf_dir):
    c = feedback.calibration_set(_labeled(spark, sf_dir), ConfidenceConfig(max_labels=500))
    return plain(c.select("building_id", "feedback_id", "action", "anomaly_score", "created_at"))


def _runs(spark, sf_dir):
    """Training runs from orders, with a version unless registration failed."""
    o = views.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    f = views.findings(spark, sf_dir)
    return o.join(f, F.concat(F.lit("f"), k.cast("string")) == f.finding_id).select(
        "tenant_id", "building_id", F.col("layer_origin").alias("model_type"), F.col("finding_id").alias("run_id"), F.col("o_custkey").alias("n_features_used"),
        F.when(k % 9 != 0, k).alias("registered_version"), (k % 400).alias("n_training_samples"), F.round(F.col("o_totalprice") / 1500000, 8).alias("train_anomaly_rate"),
        F.element_at(F.array(F.lit("calendar"), F.lit("drift"), F.lit("feedback_volume")), (k % 3 + 1).cast("int")).alias("training_trigger"),
        F.create_map(F.lit("n_features"), (k % 10).cast("double"), F.lit("train_anomaly_rate"), F.round(F.col("o_totalprice") / 1500000, 8)).alias("metrics"),
    )


def _audit(spark, sf_dir):
    f = views.findings(spark, sf_dir)
    return f.select(
        "tenant_id", F.when((F.col("status") == "confirmed") & (F.col("detected_at") < "1995-02-01"), "model.promoted").otherwise("model.promotion_rejected").alias("event_type"),
        F.to_json(F.struct("building_id", F.col("layer_origin").alias("model_type"))).alias("payload"),
    )


def promotion_counts(spark, sf_dir):
    return governance.promotion_counts(_audit(spark, sf_dir))


def _decisions(spark, sf_dir):
    return governance.promotion_gate(_runs(spark, sf_dir), _audit(spark, sf_dir))


def promotion_gate(spark, sf_dir):
    return _decisions(spark, sf_dir).select("building_id", "model_type", "run_id", "approved", "requires_human_review", "reason")


def promotion_audit(spark, sf_dir):
    return governance.promotion_audit(_decisions(spark, sf_dir)).groupBy("tenant_id", "event_type", F.get_json_object("payload", "$.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def outcome_split(spark, sf_dir):
    s = governance.outcome_split(_decisions(spark, sf_dir))
    return s.select("building_id", *[F.array_join(c, ",").alias(c) for c in ("promoted", "held", "rejected")])


def _metric_runs(spark, sf_dir):
    """Newest and second newest run per model and metric key set."""
    from pyspark.sql import Window

    w = Window.partitionBy("tenant_id", "building_id", "model_type").orderBy(F.col("run_id").desc())
    r = _runs(spark, sf_dir).withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    return r.filter("_n = 1"), r.filter("_n = 2").withColumn("metrics", F.map_concat("metrics", F.create_map(F.lit("only_here"), F.lit(1.0))))


def metric_deltas(spark, sf_dir):
    d = governance.metric_deltas(*_metric_runs(spark, sf_dir))
    return d.select("building_id", "model_type", "metric", F.round("delta", 8).alias("delta"))


def training_lines(spark, sf_dir):
    return governance.run_lines(_decisions(spark, sf_dir)).select("run_id", "lines")


def training_summaries(spark, sf_dir):
    newest = _metric_runs(spark, sf_dir)[0]
    return governance.training_summaries(governance.promotion_gate(newest, _audit(spark, sf_dir))).drop("tenant_id")


def _versions(spark, sf_dir):
    r = _runs(spark, sf_dir).filter("registered_version IS NOT NULL").select("tenant_id", "building_id", "model_type", F.col("registered_version").alias("version"))
    alias = r.groupBy("tenant_id", "building_id", "model_type").agg(F.when(F.first("model_type") == "ml_ensemble", F.max("version")).otherwise(F.min("version")).alias("version"))
    return r, alias


def champion_versions(spark, sf_dir):
    return governance.champions(*_versions(spark, sf_dir)).drop("tenant_id")


def _rollback(spark, sf_dir):
    rates = governance.false_positive_rates(views.labels(spark, sf_dir), views.findings(spark, sf_dir), *governance.rollback_window(_end(), WIDE))
    return governance.rollback_monitor(rates, governance.champions(*_versions(spark, sf_dir)), WIDE)


def rollback_monitor(spark, sf_dir):
    return _rollback(spark, sf_dir).select("building_id", "model_type", "rolled_back", "reason", "new_champion_version")


def rollback_audit(spark, sf_dir):
    """Audit rows of the decisions that a high rate led to, whether or not a version to go back to existed."""
    return governance.rollback_audit(_rollback(spark, sf_dir)).select("event_type", "payload")


def rolled_back_aliases(spark, sf_dir):
    back = _rollback(spark, sf_dir).filter("rolled_back").withColumn("version", F.col("new_champion_version"))
    return governance.promote(_versions(spark, sf_dir)[1], back).drop("tenant_id")


def _policies(spark, sf_dir):
    n = views.table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 2).alias("n")).distinct()
    return n.select(F.concat(F.lit("t"), F.col("n").cast("string")).alias("tenant_id"), F.concat(F.lit("Tenant "), F.col("n").cast("string")).alias("name"),
                    F.when(F.col("n") % 3 != 2, (F.lit(5) + F.col("n") % 3 * 10).cast("int")).alias("readings_retention_days"))


def retention_dry_run(spark, sf_dir):
    limits = retention.cutoffs(_policies(spark, sf_dir), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return retention.expired(views.readings(spark, sf_dir), limits).withColumn("readings_retention_days", F.col("readings_retention_days").cast("long"))


def retention_survivors(spark, sf_dir):
    limits = retention.cutoffs(_policies(spark, sf_dir), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return retention.retained(views.readings(spark, sf_dir), limits).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_seconds("ts")).alias("oldest"))


def retention_audit(spark, sf_dir):
    limits = retention.cutoffs(_policies(spark, sf_dir), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return retention.retention_audit(limits).drop("entity_id")


def _tables(spark, sf_dir):
    return {
        "tenants": _policies(spark, sf_dir), "buildings": views.buildings(spark, sf_dir), "circuits": views.circuits(spark, sf_dir),
        "readings": views.readings(spark, sf_dir), "calendar": feature_checks._calendar(spark, sf_dir),
        "findings": views.findings(spark, sf_dir), "feedback": views.labels(spark, sf_dir),
    }


def _targets(spark, sf_dir):
    b = views.buildings(spark, sf_dir).filter(F.substring("building_id", 2, 9).cast("int") % 2 == 0)
    return retention.require_owned(b.select("tenant_id", "building_id"), views.buildings(spark, sf_dir))


def building_erasure(spark, sf_dir):
    return retention.erase(_tables(spark, sf_dir), _targets(spark, sf_dir))[1].drop("tenant_id", "circuits_deleted")


def erasure_survivors(spark, sf_dir):
    left, _ = retention.erase(_tables(spark, sf_dir), _targets(spark, sf_dir))
    out = None
    for n in ("buildings", "circuits", "calendar", "findings", "readings", "feedback"):
        one = left[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def tenant_erasure_audit(spark, sf_dir):
    t = _policies(spark, sf_dir).filter("readings_retention_days IS NULL")
    audit = retention.erase_tenants(_tables(spark, sf_dir), t)[1]
    return audit.groupBy("tenant_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        false_positive_rates, feedback_counts, feedback_validation, feedback_status, threshold_crossings, retraining_events, calibration_sets,
        promotion_counts, promotion_gate, promotion_audit, outcome_split, metric_deltas, training_lines, training_summaries, champion_versions,
        rollback_monitor, rollback_audit, rolled_back_aliases, retention_dry_run, retention_survivors, retention_audit, building_erasure, erasure_survivors,
        tenant_erasure_audit,
    )
}

_FB = f"{sql.FINDINGS}, {sql.LABELS}"
_LAB = f"{_FB}, labeled AS (SELECT l.*, f.tenant_id, f.building_id, f.anomaly_score FROM labels_fb l JOIN findings f USING (finding_id))"
_JUDGED = f"""{_FB}, judged AS (SELECT l.*, CASE WHEN action NOT IN ('confirmed','dismissed') THEN 'Invalid feedback action: '||action
    WHEN feedback_id LIKE '%7' THEN 'Finding with ID * was not found or is not visible to this tenant.'
    WHEN confidence IS NULL THEN 'Cannot write feedback for finding * because it has no explainability bundle.' END AS rejection FROM labels_fb l JOIN findings f USING (finding_id))"""
_RUN = f"""{sql.FINDINGS}, runs AS (SELECT f.tenant_id, f.building_id, f.layer_origin AS model_type, f.finding_id AS run_id, o_custkey AS n_features_used, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END AS registered_version,
    o_orderkey % 400 AS n_training_samples, round(o_totalprice / 1500000, 8) AS rate, (['calendar','drift','feedback_volume'])[o_orderkey % 3 + 1] AS training_trigger, o_orderkey
    FROM orders JOIN findings f ON f.finding_id = 'f'||o_orderkey),
prior AS (SELECT tenant_id, building_id, layer_origin AS model_type, count(*) AS n FROM findings WHERE status = 'confirmed' AND detected_at < TIMESTAMP '1995-02-01' GROUP BY ALL),
dec0 AS (SELECT r.*, coalesce(p.n, 0) AS prior FROM runs r LEFT JOIN prior p USING (tenant_id, building_id, model_type)),
dec AS (SELECT *, registered_version IS NULL OR n_training_samples < 50 OR rate > 0.25 AS failed, prior < 3 AS review,
    CASE WHEN registered_version IS NULL THEN 'Model Registry registration did not succeed.' WHEN n_training_samples < 50 THEN 'Insufficient training samples ('||n_training_samples||' < 50).'
         WHEN rate > 0.25 THEN printf('train_anomaly_rate %.3f exceeds the sanity bound 0.250 -- likely miscalibrated.', round_even(rate * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE)
         WHEN prior < 3 THEN 'Passed automated checks; held for human review (promotion #'||(prior + 1)||' of first 3).' ELSE 'Passed automated checks; auto-promoted.' END AS reason FROM dec0)"""
_LINES = """lin AS (SELECT *, '--- '||model_type||' ---'||chr(10)||'  n_training_samples: '||n_training_samples||chr(10)||'  run_id: '||run_id||chr(10)||'  registered_version: '||coalesce(CAST(registered_version AS VARCHAR), 'None')||chr(10)
    ||printf('  metric.n_features: %.4f', (o_orderkey % 10)::DOUBLE)||chr(10)||printf('  metric.train_anomaly_rate: %.4f', round_even(rate * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE)||chr(10)
    ||'  outcome: '||CASE WHEN NOT failed AND NOT review THEN 'PROMOTED' WHEN NOT failed THEN 'HELD FOR HUMAN REVIEW' ELSE 'REJECTED' END||' -- '||reason AS lines FROM dec)"""
_FP = f"""fp AS (SELECT f.building_id, count(*) FILTER (action = 'confirmed') AS n_confirmed, count(*) FILTER (action = 'dismissed') AS n_dismissed
    FROM labels_fb l JOIN findings f USING (finding_id) WHERE f.layer_origin = 'ml_ensemble' AND l.created_at BETWEEN TIMESTAMP '2001-01-01' - INTERVAL 1500 DAY AND TIMESTAMP '2001-01-01' GROUP BY 1)"""
_CH = f"""vers AS (SELECT building_id, model_type, registered_version AS version FROM runs WHERE registered_version IS NOT NULL),
ali AS (SELECT building_id, model_type, CASE WHEN model_type = 'ml_ensemble' THEN max(version) ELSE min(version) END AS champion_version FROM vers GROUP BY building_id, model_type),
champ AS (SELECT a.*, (SELECT max(version) FROM vers v WHERE v.building_id = a.building_id AND v.model_type = a.model_type AND v.version < a.champion_version) AS previous_version FROM ali a)"""
_RB = f"""{_RUN}, {sql.LABELS}, {_FP}, {_CH}, rb0 AS (SELECT c.*, coalesce(n_confirmed + n_dismissed, 0) AS n, n_dismissed / nullif(n_confirmed + n_dismissed, 0) AS r FROM champ c LEFT JOIN fp USING (building_id)),
rb1 AS (SELECT *, printf('%.3f', round_even(r * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS t FROM rb0),
rb AS (SELECT *, n >= 10 AND r > 0.3 AND previous_version IS NOT NULL AS rolled_back, CASE WHEN n < 10 THEN 'Only '||n||' labeled feedback rows in window (< 10) -- too few to evaluate.' WHEN r <= 0.3 THEN 'false_positive_rate='||t||' within ceiling 0.300.'
    WHEN previous_version IS NULL THEN 'false_positive_rate='||t||' exceeds ceiling 0.300 but no prior version exists to roll back to.'
    ELSE 'false_positive_rate='||t||' exceeded ceiling 0.300 ('||n||' labeled samples) -- rolled back from version '||champion_version||' to '||previous_version||'.' END AS reason FROM rb1)"""
_POL = """pol AS (SELECT DISTINCT 't'||(s_suppkey//2) AS tenant_id, 'Tenant '||(s_suppkey//2) AS name, CASE WHEN (s_suppkey//2) % 3 <> 2 THEN 5 + (s_suppkey//2) % 3 * 10 END AS days FROM supplier)"""
_ER = f"""{sql.READINGS}, {sql.CIRCUITS}, {sql.BUILDINGS}, {sql.FINDINGS}, {sql.LABELS}, {feature_checks.CALENDAR},
tgt AS (SELECT building_id, name FROM buildings WHERE CAST(substr(building_id, 2) AS INT) % 2 = 0),
cnt AS (SELECT t.building_id, t.name AS name,
    (SELECT count(*) FROM labels_fb l JOIN findings f USING (finding_id) WHERE f.building_id = t.building_id) AS feedback_deleted,
    (SELECT count(*) FROM findings f WHERE f.building_id = t.building_id) AS findings_deleted,
    (SELECT count(*) FROM readings f WHERE f.building_id = t.building_id) AS readings_deleted,
    (SELECT count(*) FROM calendar f WHERE f.building_id = t.building_id) AS calendar_deleted FROM tgt t)"""

ORACLES = {
    "false_positive_rates": f"WITH {_FB}, {_FP} SELECT building_id, n_confirmed, n_dismissed, round(n_dismissed / nullif(n_confirmed + n_dismissed, 0), 6) AS false_positive_rate FROM fp",
    "feedback_counts": f"WITH {_LAB} SELECT tenant_id, building_id, count(*) AS n_labels FROM labeled GROUP BY ALL",
    "feedback_validation": f"WITH {_JUDGED} SELECT feedback_id, rejection FROM judged",
    "feedback_status": f"""WITH {_JUDGED}, last AS (SELECT finding_id, arg_max(action, (created_at, feedback_id)) AS action FROM judged WHERE rejection IS NULL GROUP BY 1)
        SELECT finding_id, coalesce(action, status) AS status FROM findings LEFT JOIN last USING (finding_id)""",
    "threshold_crossings": f"WITH {_LAB} SELECT building_id, feedback_id, created_at FROM labeled QUALIFY row_number() OVER (PARTITION BY tenant_id, building_id ORDER BY created_at, feedback_id) = 5",
    "retraining_events": f"""WITH {_LAB}, x AS (SELECT * FROM labeled QUALIFY row_number() OVER (PARTITION BY tenant_id, building_id ORDER BY created_at, feedback_id) = 5)
        SELECT tenant_id AS key, '{{"tenant_id":"'||tenant_id||'","building_id":"'||building_id||'","timestamp":"'||strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00')||'","event_type":"model.retraining.eligible","feedback_count":5,"retraining_threshold":5}}' AS value FROM x""",
    "calibration_sets": f"WITH {_LAB} SELECT building_id, feedback_id, action, anomaly_score, created_at FROM labeled QUALIFY row_number() OVER (PARTITION BY tenant_id, building_id ORDER BY created_at DESC, feedback_id) <= 500",
    "promotion_counts": f"WITH {_RUN} SELECT tenant_id, building_id, model_type, n AS prior_promotions FROM prior",
    "promotion_gate": f"WITH {_RUN} SELECT building_id, model_type, run_id, NOT failed AND NOT review AS approved, NOT failed AND review AS requires_human_review, reason FROM dec",
    "promotion_audit": f"WITH {_RUN} SELECT tenant_id, CASE WHEN NOT failed AND NOT review THEN 'model.promoted' ELSE 'model.promotion_rejected' END AS event_type, reason, count(*) AS n FROM dec GROUP BY ALL",
    "outcome_split": f"""WITH {_RUN} SELECT building_id, coalesce(string_agg(DISTINCT CASE WHEN NOT failed AND NOT review THEN model_type END, ',' ORDER BY CASE WHEN NOT failed AND NOT review THEN model_type END), '') AS promoted,
        coalesce(string_agg(DISTINCT CASE WHEN NOT failed AND review THEN model_type END, ',' ORDER BY CASE WHEN NOT failed AND review THEN model_type END), '') AS held,
        coalesce(string_agg(DISTINCT CASE WHEN failed THEN model_type END, ',' ORDER BY CASE WHEN failed THEN model_type END), '') AS rejected FROM dec GROUP BY tenant_id, building_id""",
    "metric_deltas": f"""WITH {_RUN}, n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, building_id, model_type ORDER BY run_id DESC) AS rn FROM runs),
        p AS (SELECT a.building_id, a.model_type, a.rate - b.rate AS dr, (a.o_orderkey % 10 - b.o_orderkey % 10)::DOUBLE AS df FROM n a JOIN n b ON a.tenant_id = b.tenant_id AND a.building_id = b.building_id AND a.model_type = b.model_type AND a.rn = 1 AND b.rn = 2)
        SELECT building_id, model_type, 'train_anomaly_rate' AS metric, round(dr, 8) AS delta FROM p UNION ALL SELECT building_id, model_type, 'n_features', round(df, 8) FROM p""",
    "training_lines": f"WITH {_RUN}, {_LINES} SELECT run_id, lines FROM lin",
    "training_summaries": f"""WITH {_RUN}, {_LINES}, n AS (SELECT * FROM lin QUALIFY row_number() OVER (PARTITION BY tenant_id, building_id, model_type ORDER BY run_id DESC) = 1)
        SELECT building_id, training_trigger, '=== Training Summary ==='||chr(10)||'tenant_id:        '||tenant_id||chr(10)||'building_id:      '||building_id||chr(10)||'trigger:          '||training_trigger||chr(10)
          ||'features_used:    '||max(n_features_used)||chr(10)||chr(10)||string_agg(lines, chr(10)||chr(10) ORDER BY lines) AS summary FROM n GROUP BY tenant_id, building_id, training_trigger""",
    "champion_versions": f"WITH {_RUN}, {_CH} SELECT building_id, model_type, champion_version, previous_version FROM champ",
    "rollback_monitor": f"WITH {_RB} SELECT building_id, model_type, rolled_back, reason, CASE WHEN rolled_back THEN previous_version END AS new_champion_version FROM rb",
    "rollback_audit": f"""WITH {_RB} SELECT 'model.rollback' AS event_type, '{{"building_id":"'||building_id||'","model_type":"'||model_type||'","n_labeled":'||n||',"rolled_back":'||rolled_back||',"reason":"'||reason||'"}}' AS payload
        FROM rb WHERE n >= 10 AND coalesce(r > 0.3, true)""",
    "rolled_back_aliases": f"WITH {_RB} SELECT building_id, model_type, CASE WHEN rolled_back THEN previous_version ELSE champion_version END AS version FROM rb",
    "retention_dry_run": f"""WITH {sql.READINGS}, {_POL} SELECT p.tenant_id, CAST(p.days AS BIGINT) AS readings_retention_days, count(r.ts) AS n_expired FROM pol p
        LEFT JOIN readings r ON r.tenant_id = p.tenant_id AND r.ts < TIMESTAMP '2024-01-31' - to_days(CAST(p.days AS INT)) WHERE p.days IS NOT NULL GROUP BY ALL""",
    "retention_survivors": f"""WITH {sql.READINGS}, {_POL} SELECT r.tenant_id, count(*) AS n, CAST(min(epoch(r.ts)) AS BIGINT) AS oldest FROM readings r LEFT JOIN pol p USING (tenant_id)
        WHERE p.days IS NULL OR r.ts >= TIMESTAMP '2024-01-31' - to_days(CAST(p.days AS INT)) GROUP BY 1""",
    "retention_audit": f"""WITH {_POL} SELECT tenant_id, 'retention.enforcement' AS event_type, '{{"readings_retention_days":'||days||',"cutoff":"'||strftime(TIMESTAMP '2024-01-31' - to_days(CAST(days AS INT)), '%Y-%m-%dT%H:%M:%S+00:00')||'"}}' AS payload FROM pol WHERE days IS NOT NULL""",
    "building_erasure": f"WITH {_ER} SELECT * FROM cnt",
    "erasure_survivors": f"""WITH {_ER} SELECT 'buildings' AS table_name, count(*) AS n FROM buildings WHERE building_id NOT IN (SELECT building_id FROM tgt)
        UNION ALL SELECT 'circuits', count(*) FROM circuits WHERE building_id NOT IN (SELECT building_id FROM tgt) UNION ALL SELECT 'calendar', count(*) FROM calendar WHERE building_id NOT IN (SELECT building_id FROM tgt)
        UNION ALL SELECT 'findings', count(*) FROM findings WHERE building_id NOT IN (SELECT building_id FROM tgt) UNION ALL SELECT 'readings', count(*) FROM readings WHERE building_id NOT IN (SELECT building_id FROM tgt)
        UNION ALL SELECT 'feedback', count(*) FROM labels_fb l JOIN findings f USING (finding_id) WHERE f.building_id NOT IN (SELECT building_id FROM tgt)""",
    "tenant_erasure_audit": f"""WITH {_POL}, {sql.BUILDINGS}, g AS (SELECT tenant_id FROM pol WHERE days IS NULL), k AS (SELECT tenant_id, count(*) AS n FROM buildings WHERE tenant_id IN (SELECT tenant_id FROM g) GROUP BY 1)
        SELECT tenant_id, e AS event_type, CASE WHEN e LIKE 'tenant%' THEN 1 ELSE n END AS n FROM k CROSS JOIN (SELECT unnest(['tenant.data.deletion_initiated','tenant.data.deletion_completed','building.data.deleted','building.data.deletion_completed']) AS e)""",
}
