"""The sensor dictionary: import and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["name", "description", "unit", "example"]


def normalize(rows: DataFrame, collection_id: int | None = None) -> DataFrame:
    """Trimmed rows that have an id and a name; empty texts become null."""
    out = rows.withColumn("collection_id", F.lit(collection_id).cast("bigint")) if collection_id is not None else rows
    clean = {c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in ("id", *FIELDS)}
    kept = out.withColumns(clean).where("id is not null and name is not null")
    return kept.withColumnRenamed("id", "sensor_id")


def read_csv(spark: SparkSession, path: str, collection_id: int) -> DataFrame:
    """Sensors of a CSV with header id,name,description,unit,example; an import without any is an error."""
    raw = (
        spark.read.option("header", True)
        .schema("id string, name string, description string, unit string, example string")
        .csv(path)
        .withColumn("position", F.monotonically_increasing_id())
    )
    found = normalize(raw, collection_id)
    if found.isEmpty():
        raise ValueError("no valid sensors found")
    return found


def upsert(target: DataFrame, source: DataFrame, position: str = "position") -> DataFrame:
    """Target with the source rows put in on (collection_id, sensor_id); the last source row of a key wins."""
    keys = ["collection_id", "sensor_id"]
    latest = source.groupBy(*keys).agg(F.max_by(F.struct(*FIELDS), position).alias("new"))
    merged = target.join(latest, keys, "full_outer")
    return merged.select(
        *keys, *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS]
    )
