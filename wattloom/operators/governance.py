"""Promotion gate, rollback monitor, model versions and training summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.config import PromotionConfig, RollbackConfig
from wattloom.functions.scalars import days_before, fixed_text

BUILDING = ["tenant_id", "building_id"]
MODEL = [*BUILDING, "model_type"]


# --- versions ----------------------------------------------------------------------------------
def champions(versions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Champion per model and the largest version below it."""
    joined = versions.join(aliases.select(*MODEL, F.col("version").alias("champion_version")), MODEL)
    below = F.when(F.col("version") < F.col("champion_version"), F.col("version"))
    return joined.groupBy(*MODEL, "champion_version").agg(F.max(below).alias("previous_version"))


def promote(aliases: DataFrame, decided: DataFrame) -> DataFrame:
    """Alias table with the decided versions (MODEL, version) put in."""
    from wattloom.sinks.merge import upsert

    return upsert(aliases, decided.select(*MODEL, "version"), MODEL, ["version"], ("version",))


# --- promotion ---------------------------------------------------------------------------------
def promotion_counts(audit: DataFrame) -> DataFrame:
    """Promotions so far per model, read from the audit log's JSON payloads."""
    return (
        audit.filter("event_type = 'model.promoted'")
        .select(
            "tenant_id",
            F.get_json_object("payload", "$.building_id").alias("building_id"),
            F.get_json_object("payload", "$.model_type").alias("model_type"),
        )
        .groupBy(*MODEL)
        .agg(F.count(F.lit(1)).alias("prior_promotions"))
    )


def promotion_gate(runs: DataFrame, audit: DataFrame, cfg: PromotionConfig = PromotionConfig()) -> DataFrame:
    """Decision per training run: the first failing check speaks, then the review of early promotions."""
    j = runs.join(promotion_counts(audit), MODEL, "left").withColumn("prior_promotions", F.coalesce("prior_promotions", F.lit(0)))
    unregistered = F.col("registered_version").isNull()
    few = F.col("n_training_samples") < cfg.min_samples
    noisy = F.coalesce(F.col("train_anomaly_rate") > cfg.max_anomaly_rate, F.lit(False))
    review = F.col("prior_promotions") < cfg.reviewed_promotions
    s = lambda c: c.cast("string")
    reason = (
        F.when(unregistered, "Model Registry registration did not succeed.")
        .when(few, F.concat(F.lit("Insufficient training samples ("), s(F.col("n_training_samples")), F.lit(f" < {cfg.min_samples}).")))
        .when(
            noisy,
            F.concat(F.lit("train_anomaly_rate "), fixed_text("train_anomaly_rate", 3),
                     F.lit(f" exceeds the sanity bound {cfg.max_anomaly_rate:.3f} -- likely miscalibrated.")),
        )
        .when(
            review,
            F.concat(F.lit("Passed automated checks; held for human review (promotion #"), s(F.col("prior_promotions") + 1),
                     F.lit(f" of first {cfg.reviewed_promotions}).")),
        )
        .otherwise("Passed automated checks; auto-promoted.")
    )
    failed = unregistered | few | noisy
    return j.withColumns(
        {"approved": ~failed & ~review, "requires_human_review": ~failed & review, "reason": reason}
    )


def promotion_audit(decisions: DataFrame) -> DataFrame:
    from wattloom.sinks.records import audit_rows

    event = F.when(F.col("approved"), "model.promoted").otherwise("model.promotion_rejected")
    cols = ["building_id", "model_type", "run_id", "registered_version", "training_trigger", "n_training_samples", "approved", "requires_human_review", "reason"]
    return audit_rows(decisions, event, [*[F.col(c) for c in cols], F.lit("automated_gate").alias("promoting_actor")])


def promoted_aliases(decisions: DataFrame) -> DataFrame:
    return decisions.filter("approved").select(*MODEL, F.col("registered_version").alias("version"))


# --- rollback ----------------------------------------------------------------------------------
def label_counts(labels: DataFrame, start: Column, end: Column) -> DataFrame:
    """Labels of a window per finding and action; summed before they meet the findings."""
    return labels.filter(F.col("created_at").between(start, end)).groupBy("finding_id").agg(
        F.count_if(F.col("action") == "confirmed").alias("_confirmed"), F.count_if(F.col("action") == "dismissed").alias("_dismissed")
    )


def false_positive_rates(labels: DataFrame, findings: DataFrame, start: Column, end: Column) -> DataFrame:
    """Dismissed share of the labeled ensemble findings per building; null without labels."""
    ml = findings.filter("layer_origin = 'ml_ensemble'").select(*BUILDING, "finding_id")
    return (
        ml.join(label_counts(labels, start, end), "finding_id")
        .groupBy(*BUILDING)
        .agg(F.sum("_confirmed").alias("n_confirmed"), F.sum("_dismissed").alias("n_dismissed"))
        .withColumn("n_labeled", F.col("n_confirmed") + F.col("n_dismissed"))
        .withColumn("false_positive_rate", F.try_divide(F.col("n_dismissed"), F.col("n_labeled")))
    )


def rollback_monitor(rates: DataFrame, models: DataFrame, cfg: RollbackConfig = RollbackConfig()) -> DataFrame:
    """Decision per model of `champions`: keep, cannot roll back, or back to the previous version."""
    j = models.join(rates, BUILDING, "left").withColumn("n_labeled", F.coalesce("n_labeled", F.lit(0)))
    rate = fixed_text("false_positive_rate", 3)
    few = F.col("n_labeled") < cfg.min_labels
    fine = F.col("false_positive_rate") <= cfg.max_fp_rate
    none = F.col("previous_version").isNull()
    limit = f"{cfg.max_fp_rate:.3f}"
    reason = (
        F.when(few, F.concat(F.lit("Only "), F.col("n_labeled").cast("string"), F.lit(f" labeled feedback rows in window (< {cfg.min_labels}) -- too few to evaluate.")))
        .when(fine, F.concat(F.lit("false_positive_rate="), rate, F.lit(f" within ceiling {limit}.")))
        .when(none, F.concat(F.lit("false_positive_rate="), rate, F.lit(f" exceeds ceiling {limit} but no prior version exists to roll back to.")))
        .otherwise(
            F.concat(F.lit("false_positive_rate="), rate, F.lit(f" exceeded ceiling {limit} ("), F.col("n_labeled").cast("string"),
                     F.lit(" labeled samples) -- rolled back from version "), F.col("champion_version").cast("string"),
                     F.lit(" to "), F.col("previous_version").cast("string"), F.lit("."))
        )
    )
    back = ~few & ~fine & ~none
    return j.withColumns(
        {"rolled_back": back, "reason": reason, "new_champion_version": F.when(back, F.col("previous_version")), "_audited": ~few & ~fine}
    )


def rollback_audit(decisions: DataFrame) -> DataFrame:
    from wattloom.sinks.records import audit_rows

    cols = ["building_id", "model_type", "n_labeled", "rolled_back", "reason"]
    return audit_rows(decisions.filter("_audited"), F.lit("model.rollback"), [F.col(c) for c in cols])


def rollback_window(as_of: Column, cfg: RollbackConfig = RollbackConfig()) -> tuple[Column, Column]:
    return days_before(as_of, cfg.days), as_of


# --- training reports ---------------------------------------------------------------------------
def metric_deltas(candidates: DataFrame, previous: DataFrame) -> DataFrame:
    """Candidate minus previous for the metrics both runs carry (`metrics` maps)."""
    long = lambda df, name: df.select(*MODEL, F.explode("metrics").alias("metric", name))
    return long(candidates, "candidate").join(long(previous, "previous"), [*MODEL, "metric"]).withColumn(
        "delta", F.col("candidate") - F.col("previous")
    )


def outcome_split(decisions: DataFrame) -> DataFrame:
    """Promoted, held and rejected model types per building (at most one entry per model type)."""
    pick = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("model_type"))))
    ok, held = F.col("approved"), F.col("requires_human_review")
    return decisions.groupBy(*BUILDING).agg(
        pick(ok).alias("promoted"), pick(~ok & held).alias("held"), pick(~ok & ~held).alias("rejected")
    )


def run_lines(decisions: DataFrame) -> DataFrame:
    """Text block of one training run."""
    word = F.when(F.col("approved"), "PROMOTED").when(F.col("requires_human_review"), "HELD FOR HUMAN REVIEW").otherwise("REJECTED")
    metrics = F.transform(
        F.array_sort(F.map_entries("metrics")),
        lambda e: F.concat(F.lit("  metric."), e["key"], F.lit(": "), F.format_string("%.4f", F.rint(e["value"] * 10000.0) / 10000.0)),
    )
    line = F.array_join(
        F.concat(
            F.array(
                F.concat(F.lit("--- "), F.col("model_type"), F.lit(" ---")),
                F.concat(F.lit("  n_training_samples: "), F.col("n_training_samples").cast("string")),
                F.concat(F.lit("  run_id: "), F.col("run_id")),
                F.concat(F.lit("  registered_version: "), F.coalesce(F.col("registered_version").cast("string"), F.lit("None"))),
            ),
            metrics,
            F.array(F.concat(F.lit("  outcome: "), word, F.lit(" -- "), F.col("reason"))),
        ),
        "\n",
    )
    return decisions.withColumn("lines", line)


def training_summaries(decisions: DataFrame) -> DataFrame:
    """Summary text per building and trigger: header, then one block per model type trained."""
    blocks = run_lines(decisions).groupBy(*BUILDING, "training_trigger").agg(
        F.max("n_features_used").alias("n_features_used"), F.array_sort(F.collect_set("lines")).alias("_b")
    )
    head = F.concat(
        F.lit("=== Training Summary ===\ntenant_id:        "), F.col("tenant_id"), F.lit("\nbuilding_id:      "), F.col("building_id"),
        F.lit("\ntrigger:          "), F.col("training_trigger"), F.lit("\nfeatures_used:    "), F.col("n_features_used").cast("string"),
    )
    return blocks.select(*BUILDING, "training_trigger", F.concat(head, F.lit("\n\n"), F.array_join("_b", "\n\n")).alias("summary"))
