"""Batching rules for review and applying the merge, simplify and remove actions that come back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions import rulecalls, texts
from gaugeflow.model import ACTION_TYPES, MAX_RULES_PER_BATCH
from gaugeflow.operators import layout, rulebase

NO_SENSORS = "__no_sensors__"


def batches(rules: DataFrame, size: int = MAX_RULES_PER_BATCH, group_layout: str = "auto", whole_up_to: int = 0) -> DataFrame:
    """Rules plus (batch_key, batch_no): rules reading the same sensors together, at most ``size`` each.

    A rule's sensors are those of its syntax tree; a text that does not parse has none. With
    ``whole_up_to``, a table of so many rules or fewer is one batch, ``all``. A rule's place within its sensor set is
    counted with the layout for large keys, as one set may be most of the table.
    """
    if whole_up_to and rules.limit(whole_up_to + 1).count() <= whole_up_to:
        return rules.withColumns({"batch_key": F.lit("all"), "batch_no": F.lit(0).cast("bigint")})
    # parsed once per distinct text and written: sets are counted before rules are placed in them
    keyed = texts.once(rules, "rule_body", "_sensors", rulecalls.sensor_set, keep=lambda told: layout.stored(told, "sensors"))
    keyed = keyed.withColumn("batch_key", F.when(F.size("_sensors") > 0, F.array_join("_sensors", ",")).otherwise(NO_SENSORS)).drop("_sensors")
    placed = layout.running_count(keyed, ["batch_key"], ["rule_id"], name="_place", layout=group_layout)
    return placed.withColumn("batch_no", F.floor((F.col("_place") - 1) / F.lit(size))).drop("_place")


def batch_summary(batched: DataFrame) -> DataFrame:
    """One row: analyzed_rules, rule_batches, avg_batch_size (whole)."""
    per_batch = batched.groupBy("batch_key", "batch_no").agg(F.count(F.lit(1)).alias("rules"))
    return per_batch.agg(
        F.coalesce(F.sum("rules"), F.lit(0)).alias("analyzed_rules"), F.count(F.lit(1)).alias("rule_batches")
    ).select(
        "analyzed_rules",
        "rule_batches",
        F.coalesce(F.floor(F.try_divide(F.col("analyzed_rules"), F.col("rule_batches"))), F.lit(0)).alias("avg_batch_size"),
    )


def action_errors(actions_type: Column, ids: Column, confidence: Column, reasoning: Column) -> Column:
    checks = [
        (~F.coalesce(actions_type.isin(list(ACTION_TYPES)), F.lit(False)), "action_type"),
        (F.coalesce(F.size(ids), F.lit(0)) < 1, "input_rule_ids"),
        (~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence"),
        (F.coalesce(F.length(reasoning), F.lit(0)) < 10, "reasoning"),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda e: e.isNotNull())


def check_actions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) actions; rejected ones carry ``errors``."""
    errors = action_errors(F.col("action_type"), F.col("input_rule_ids"), F.col("confidence"), F.col("reasoning"))
    checked = actions.withColumn("errors", errors)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def confident(actions: DataFrame, threshold: float = 0.7) -> DataFrame:
    return actions.where(F.col("confidence") >= threshold)


def verify_outputs(actions: DataFrame, sensors: DataFrame) -> DataFrame:
    """Actions with an output rule, plus ``passed`` and ``reason``.

    Passing outputs carry their lineage and ok statuses, ready to become rules.
    """
    outputs = actions.where("output_rule is not null")
    as_rules = outputs.select(F.col("action_id").alias("rule_id"), F.coalesce("output_rule.rule_body", F.lit("")).alias("rule_body"))
    verdict = rulebase.verify(as_rules, sensors).select(F.col("rule_id").alias("action_id"), "verification_status")
    passed = F.col("verification_status") == "ok"
    ok = F.when(passed, F.lit("ok"))
    return (
        outputs.join(verdict, "action_id")
        .withColumns(
            {
                "passed": passed,
                "reason": F.when(F.col("verification_status") == "syntax_error", F.lit("Syntax error")).when(~passed, F.lit("Validation failed")),
                "consolidated_from_ids": F.when(passed, F.col("input_rule_ids")),
                "is_consolidated": passed,
                "lifecycle_status": F.when(passed, F.lit("consolidated")),
                "sensor_parsing_status": ok,
                "time_parsing_status": ok,
            }
        )
        .withColumn("verification_status", ok)
    )


def superseded_ids(actions: DataFrame, verified: DataFrame, parity: bool = False) -> DataFrame:
    """Distinct ids of rules that the actions replace.

    Removed rules and the inputs of outputs that passed. With ``parity``, the inputs of every
    action that has an output, passed or not, and of no removal.
    """
    if parity:
        used = actions.where("output_rule is not null").select("input_rule_ids")
    else:
        removed = actions.where((F.col("action_type") == "remove") & F.col("output_rule").isNull()).select("input_rule_ids")
        used = removed.unionByName(verified.where("passed").select("input_rule_ids"))
    return used.select(F.explode("input_rule_ids").alias("rule_id")).distinct()


def summarize(rules: DataFrame, actions: DataFrame, verified: DataFrame, superseded: DataFrame) -> DataFrame:
    """One row of counters, from one row per table."""
    parts = [
        rules.agg(F.count(F.lit(1)).alias("input_count")),
        verified.agg(F.count_if("passed").alias("output_count"), F.count_if(~F.col("passed")).alias("failed_count")),
        superseded.agg(F.count(F.lit(1)).alias("superseded_count")),
        actions.agg(*[F.count_if(F.col("action_type") == a).alias(f"{a}_count") for a in ACTION_TYPES]),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = ["input_count", "output_count", "superseded_count", "remove_count", "merge_count", "simplify_count", "failed_count"]
    return rows.agg(*[F.max(n).alias(n) for n in names])


def apply_actions(rules: DataFrame, verified: DataFrame, superseded: DataFrame, job_id: int) -> tuple[DataFrame, DataFrame]:
    """(all rules with their new lifecycle, new rules).

    New rules take task, collection, document, chunk and preview from the lowest input id that
    exists; an output with no existing input is not stored.
    """
    marked = (
        rules.join(superseded.withColumn("_gone", F.lit(True)), "rule_id", "left")
        .withColumn("lifecycle_status", F.when(F.col("_gone"), F.lit("superseded")).otherwise(F.col("lifecycle_status")))
        .drop("_gone")
    )
    inherited = ["task_id", "collection_id", "document_id", "chunk_id", "source_chunk_preview"]
    passed = verified.where("passed")
    origins = (
        passed.select("action_id", F.explode(F.array_distinct("input_rule_ids")).alias("rule_id"))
        .join(rules.select("rule_id", *inherited), "rule_id")
        .groupBy("action_id")
        .agg(F.min_by(F.struct(*inherited), "rule_id").alias("origin"))
    )
    created = passed.join(origins, "action_id").select(
        "action_id",
        "origin.*",
        *[F.col(f"output_rule.{f}").alias(f) for f in rulebase.RULE_FIELDS],
        F.col("output_rule.rule_body").alias("rule_body_original"),
        "sensor_parsing_status",
        "time_parsing_status",
        "verification_status",
        "lifecycle_status",
        "is_consolidated",
        "consolidated_from_ids",
        F.col("confidence").alias("consolidation_confidence"),
        F.col("reasoning").alias("consolidation_reasoning"),
        F.lit(job_id).cast("bigint").alias("consolidation_job_id"),
    )
    return marked, created


def not_yet_applied(jobs: DataFrame, rules: DataFrame) -> DataFrame:
    """Jobs without output rules: an applied job is not applied again."""
    done = rules.where("is_consolidated").select(F.col("consolidation_job_id").alias("job_id"))
    return jobs.join(done, "job_id", "left_anti")


def already_applied(jobs: DataFrame, rules: DataFrame) -> DataFrame:
    done = rules.where("is_consolidated").select(F.col("consolidation_job_id").alias("job_id"))
    return jobs.join(done, "job_id", "left_semi")


def ratios(jobs: DataFrame) -> DataFrame:
    """Reduction in percent and input rules per output rule."""
    inputs, outputs = F.col("input_count"), F.col("output_count")
    present = (inputs > 0) & (outputs > 0)
    return jobs.withColumns(
        {
            "reduction_percent": F.when(present, F.try_divide(inputs - outputs, inputs) * 100),
            "consolidation_ratio": F.when(present, F.try_divide(inputs, outputs)),
        }
    )
