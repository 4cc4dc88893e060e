"""Folders that executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gaugeflow.operators.layout import reliable_dir


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of its own only where none is set and Spark is one process, as in tests."""
    return reliable_dir(spark)


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read back; survives lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of so many rows: the default of 10,000 holds tens of MB of text in each worker and in the JVM."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
