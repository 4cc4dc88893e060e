"""Where events go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flat(events: DataFrame) -> DataFrame:
    """Events as text columns only: the sensor map becomes JSON."""
    return events.withColumn("sensor_values", F.to_json("sensor_values"))


def write_csv(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``mode``: overwrite or append. Part files each carry the header; readers skip it."""
    flat(events).write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "asset string, timestamp timestamp, seq bigint, rule_name string, triggered boolean, "
        "result string, sensor_values string, explanation string, rule_description string"
    )
    rows = spark.read.option("header", True).schema(schema).csv(path)
    return rows.withColumn("sensor_values", F.from_json("sensor_values", "map<string,double>"))


def write_parquet(events: DataFrame, path: str, mode: str = "append") -> None:
    """Columnar event log, laid out by day so later reads prune."""
    events.withColumn("day", F.to_date("timestamp")).write.mode(mode).partitionBy("day").parquet(path)
