"""Sensor readings, long or wide, batch or stream, to the canonical long shape.

Canonical: asset string ('' when there is one plant), sensor_id string, ts, ts_us bigint, seq
bigint (order within one ts; LATER in a stream where none was given), value double with NaN turned into null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


# In place of seq in a stream that names none: the operators of ``streaming`` number an instant once all its readings are there.
LATER = -(1 << 63)


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without a time zone."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts))


def number(value: Column) -> Column:
    """Value as double; NaN counts as missing."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def from_long(
    df: DataFrame, sensor: str = "sensor_id", ts: str = "ts", value: str = "value", asset: str | None = None, seq: str | None = None
) -> DataFrame:
    """Canonical readings.

    Without ``seq`` the readings of a sensor at one instant are numbered by value, so that none is
    taken for another; those of a stream get LATER and are numbered alike by ``status_stream`` and
    ``microbatch``. A column named in ``seq`` must tell them apart: see ``repeated``.
    """
    if isinstance(df.schema[ts].dataType, T.StringType):
        df = df.withColumn(ts, F.to_timestamp(ts))
    if not seq and not df.isStreaming:
        same = W.partitionBy(*[F.col(c) for c in (asset, sensor, ts) if c]).orderBy(number(F.col(value)))
        df, seq = df.withColumn("_seq", F.row_number().over(same) - 1), "_seq"
    return df.select(
        (F.coalesce(F.col(asset).cast("string"), F.lit("")) if asset else F.lit("")).alias("asset"),
        F.col(sensor).cast("string").alias("sensor_id"),
        F.col(ts).alias("ts"),
        micros(df, ts).alias("ts_us"),
        (F.col(seq).cast("bigint") if seq else F.lit(LATER if df.isStreaming else 0).cast("bigint")).alias("seq"),
        number(F.col(value)).alias("value"),
    )


def from_wide(
    df: DataFrame, sensors: Sequence[str] | None = None, ts: str = "ts", asset: str | None = None, seq: str | None = None
) -> DataFrame:
    """One row per sensor column; only ``sensors`` are read when given. A stream must name its ``seq``, or its rows of one instant would be mixed."""
    if not seq and df.isStreaming:
        raise ValueError("name the column in seq that tells rows of one instant apart; a wide stream can't be numbered")
    ids = [c for c in (asset, ts, seq) if c]
    sensors = list(sensors) if sensors is not None else [c for c in df.columns if c not in ids]
    numbers = df.select(*ids, *[F.col(f"`{s}`").cast("double").alias(s) for s in sensors])
    if not seq:  # rows of one instant stay the rows they are
        same = W.partitionBy(*[F.col(c) for c in (asset, ts) if c]).orderBy(*[F.col(f"`{s}`") for s in sensors])
        numbers, seq, ids = numbers.withColumn("_seq", F.row_number().over(same) - 1), "_seq", [*ids, "_seq"]
    return from_long(numbers.unpivot(ids, sensors, "sensor_id", "value"), "sensor_id", ts, "value", asset, seq)


def numbered(readings: DataFrame) -> DataFrame:
    """Readings with LATER numbered by value, as ``from_long`` numbers a batch; all readings of their instants must be there."""
    same = W.partitionBy("asset", "sensor_id", "ts_us").orderBy("value")
    later = readings.where(F.col("seq") == LATER).withColumn("seq", (F.row_number().over(same) - 1).cast("bigint"))
    return readings.where(F.coalesce(F.col("seq") != LATER, F.lit(True))).unionByName(later)


def repeated(readings: DataFrame) -> DataFrame:
    """Keys (asset, sensor_id, ts_us, seq) that more than one reading has, with their number; there should be none."""
    return readings.groupBy("asset", "sensor_id", "ts_us", "seq").agg(F.count(F.lit(1)).alias("readings")).where("readings > 1")


def to_wide(readings: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """One row per (asset, ts, seq); ``sensors`` come from the rules, never from the data."""
    return (
        readings.where(F.col("sensor_id").isin(list(sensors)))
        .groupBy("asset", "ts", "ts_us", "seq")
        .pivot("sensor_id", list(sensors))
        .agg(F.max("value"))
    )


def aligned(readings: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Give every sensor a row, null where it has no reading, at every (asset, ts, seq).

    This is what a wide frame says implicitly, and what lets a rule see the last 10 samples of
    one sensor at the time of another. The rows to fill are those of all readings, so the pivot
    is over unfiltered keys.
    """
    wide = readings.groupBy("asset", "ts", "ts_us", "seq").agg(
        *[F.max(F.when(F.col("sensor_id") == s, F.col("value"))).alias(s) for s in sensors]
    )
    return wide.unpivot(["asset", "ts", "ts_us", "seq"], list(sensors), "sensor_id", "value").select(
        "asset", "sensor_id", "ts", "ts_us", "seq", "value"
    )


def scan(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def summary(readings: DataFrame) -> DataFrame:
    """Count, mean, std, min, quartiles and max per sensor."""
    v = F.col("value")
    return readings.groupBy("sensor_id").agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.percentile(v, F.lit(0.25)).alias("q25"),
        F.percentile(v, F.lit(0.5)).alias("q50"),
        F.percentile(v, F.lit(0.75)).alias("q75"),
        F.max(v).alias("max"),
    )
