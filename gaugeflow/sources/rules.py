"""Loading rules to check or to consolidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOADED = [
    "rule_name", "rule_body", "rule_description", "rule_reasoning", "rule_source", "rule_type",
    "sensor_parsing_status", "time_parsing_status", "verification_status",
]


def load_rules(
    rules: DataFrame, collection_id: int | None = None, task_id: int | None = None, limit: int | None = None, parity: bool = False
) -> DataFrame:
    """Verified rules of a task, else of a collection.

    ``limit`` keeps the newest so many rules, counted before the verified ones are kept. Superseded rules are left out;
    ``parity`` keeps them.
    """
    if task_id is not None:
        chosen = rules.where(F.col("task_id") == task_id)
    elif collection_id is not None:
        chosen = rules.where(F.col("collection_id") == collection_id).orderBy(F.desc("created_at"), "id")
        chosen = chosen if limit is None else chosen.limit(limit)
    else:
        raise ValueError("give collection_id or task_id")
    if not parity:
        chosen = chosen.where("lifecycle_status <> 'superseded'")
    return chosen.where("verification_status = 'ok'").select(*LOADED)


def load_all(rules: DataFrame, limit: int | None = None, parity: bool = False) -> DataFrame:
    """``load_rules`` for every collection at once, with its collection_id and id."""
    chosen = rules
    if limit is not None:
        newest = W.partitionBy("collection_id").orderBy(F.desc("created_at"), "id")
        chosen = rules.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= limit)
    if not parity:
        chosen = chosen.where("lifecycle_status <> 'superseded'")
    return chosen.where("verification_status = 'ok'").select("collection_id", "id", *LOADED)


def from_dicts(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules given in a program."""
    return spark.createDataFrame(
        [(i, r.get("rule_name"), r.get("rule_description", ""), r.get("rule_body")) for i, r in enumerate(rules)],
        "rule_id bigint, rule_name string, rule_description string, rule_body string",
    )


def for_consolidation(rules: DataFrame) -> DataFrame:
    """The ten columns consolidation reads."""
    return rules.select("id", *LOADED)


def sensors_for_consolidation(sensors: DataFrame) -> DataFrame:
    return sensors.select("sensor_id", "name", "description", "unit")
