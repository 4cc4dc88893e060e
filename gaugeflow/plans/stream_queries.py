"""Streams (S3, S9, S10, X1-X4): the events table arriving as files."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.model import Requirement
from gaugeflow.operators import layout
from gaugeflow.operators import rules as ru
from gaugeflow.plans.feature_queries import FRAME, READINGS, event_readings, last
from gaugeflow.plans.registry import query, table
from gaugeflow.plans.rule_queries import CONDITION, DEMO, EVENTS_SQL, TOGETHER
from gaugeflow.sources import readings as rd
from gaugeflow.sources import sinks
from gaugeflow.streaming import stateful


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder, shared by the executors."""
    return f"{layout.reliable_dir(spark)}/{name}-{uuid4().hex}"


SLICES = 4


def event_stream(spark: SparkSession, folder: str, assets: bool = False, where: str | None = None) -> DataFrame:
    """The events table as a stream of readings: its one file, or with ``where`` SLICES slices of its time, one per batch,
    and what ends the stream. A slice has a file per task of the scan; short of that, empty files make up their number."""
    asset = "asset" if assets else None
    reading = {"value": F.expr("if(event_id % 11 = 0, null, value)"), "asset": F.col("user_id") % 10}
    events = table(spark, folder, "events")
    if where is None:
        rows = rd.stream(spark, folder, events.schema, pathGlobFilter="events.parquet")
        return rd.from_long(rows.withColumns(reading), "event_type", "ts", "value", asset, seq="event_id")
    rows = rd.from_long(events.withColumns(reading), "event_type", "ts", "value", asset, seq="event_id").withColumn("ts", F.timestamp_micros("ts_us"))
    low, high, tasks = rows.withColumn("_task", F.spark_partition_id()).agg(F.min("ts_us"), F.max("ts_us"), F.count_distinct("_task")).first()
    place = F.least(F.floor((F.col("ts_us") - low) * SLICES / F.lit(max(1, high - low))), F.lit(SLICES - 1))
    for number in range(SLICES):  # one after the other: a file's age is its place in the stream
        rows.where(place == number).repartition(tasks).write.mode("append").parquet(f"{where}/events")
        for _ in range(tasks * (number + 1) - len(spark.read.schema(stateful.BEAT).parquet(f"{where}/events").inputFiles())):
            spark.createDataFrame([], stateful.BEAT).coalesce(1).write.mode("append").parquet(f"{where}/events")
    stateful.close(spark, f"{where}/events")
    return rd.stream(spark, f"{where}/events", stateful.BEAT, maxFilesPerTrigger=tasks)


def drain(stream: DataFrame, where: str) -> DataFrame:
    """Run an append stream over what is there now, and read what it wrote."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint").option("path", f"{where}/out")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{where}/out")


@query(
    "x01_stream_features",
    f"""WITH {READINGS}, f AS (SELECT seq, sensor_id, value, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS peak
    FROM counted WINDOW w AS (PARTITION BY sensor_id ORDER BY {last(10)}))
    SELECT seq, sensor_id, value, mean, peak FROM f""",
)
def stream_features(spark: SparkSession, folder: str) -> DataFrame:
    asked = [Requirement("any", "0"), Requirement("any", "10m:", "mean"), Requirement("any", "10m:", "max")]
    where = work_dir(spark, "features")
    readings = stateful.timed(event_stream(spark, folder, where=where))
    out = drain(stateful.status_stream(readings, asked, delay="1 hour", by_sensor=True), where)
    return out.select(
        "seq", "sensor_id", F.col("`0`").alias("value"), F.round("`10m:@mean`", 6).alias("mean"), F.col("`10m:@max`").alias("peak")
    )


# The same side by side, for each of ten assets by itself.
ASSET_FRAME = FRAME.replace("event_id AS seq, ts,", "event_id AS seq, ts, user_id % 10 AS asset,").replace("OVER (ORDER BY", "OVER (PARTITION BY asset ORDER BY")


@query("x02_stream_status", f"WITH {ASSET_FRAME} SELECT seq, round(view_mean, 6) AS view_mean, error_max FROM status")
def stream_status(spark: SparkSession, folder: str) -> DataFrame:
    _, asked = TOGETHER.compile()
    where = work_dir(spark, "status")
    out = drain(stateful.status_stream(stateful.timed(event_stream(spark, folder, True, where)), asked, delay="1 hour"), where)
    return out.select("seq", F.round("`view|10m:@mean`", 6).alias("view_mean"), F.col("`error|10m:@max`").alias("error_max"))


@query("x03_stream_rules", f"WITH {ASSET_FRAME} SELECT seq, 'view_and_error' AS rule_name FROM status WHERE {CONDITION['view_and_error']}")
def stream_rules(spark: SparkSession, folder: str) -> DataFrame:
    where = work_dir(spark, "rules")
    found = stateful.rule_stream(event_stream(spark, folder, True, where), [TOGETHER], delay="1 hour")
    return drain(found, where).select("seq", "rule_name")


@query("x04_stream_events", EVENTS_SQL + "SELECT seq, rule_name, result FROM fired")
def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    where = work_dir(spark, "events")
    return drain(stateful.rule_stream(event_stream(spark, folder, where=where), DEMO, delay="1 hour"), where).select("seq", "rule_name", "result")


LATE = f"""WITH {READINGS}, arriving AS (
  SELECT seq, sensor_id, ts, value, seq % 50 = 7 AND ts < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR AS late FROM counted
), kept AS (SELECT *, count(value) OVER (PARTITION BY sensor_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM arriving WHERE NOT late)
"""


@query(
    "x03_stream_late_rows",
    LATE
    + """SELECT 'answered' AS kind, count(*) AS readings, CAST(count(peak) AS BIGINT) AS peaks FROM
      (SELECT max(value) OVER (PARTITION BY sensor_id ORDER BY n RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS peak FROM kept)
    UNION ALL SELECT 'late', count(*), 0 FROM arriving WHERE late""",
)
def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One reading in fifty comes after all others: those more than the delay behind are counted by Spark, and no window holds them."""
    where = work_dir(spark, "late")
    rows = event_readings(spark, folder).withColumn("ts", F.timestamp_micros("ts_us"))
    kept = F.col("seq") % 50 == 7
    rows.where(~kept).write.parquet(f"{where}/first")
    stream = rd.stream(spark, f"{where}/first", stateful.BEAT)
    both = stream.unionByName(stateful.heartbeats(spark, f"{where}/beats"))
    answered = stateful.status_stream(stateful.timed(both), [Requirement("any", "10m:", "max")], delay="2 hours", by_sensor=True)
    drain(answered, where)
    rows.where(kept).write.mode("append").parquet(f"{where}/first")
    writer = answered.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint").option("path", f"{where}/out")
    late = 0
    for end in (False, True):
        if end:
            stateful.close(spark, f"{where}/beats")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        late += sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    out = spark.read.schema(answered.schema).parquet(f"{where}/out")
    told = out.agg(F.lit("answered").alias("kind"), F.count(F.lit(1)).alias("readings"), F.count("`10m:@max`").alias("peaks"))
    return told.unionByName(spark.createDataFrame([("late", late, 0)], told.schema))


@query("s03_stream_input", "SELECT event_id AS seq, event_type AS sensor_id, CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM events")
def stream_input(spark: SparkSession, folder: str) -> DataFrame:
    return drain(event_stream(spark, folder), work_dir(spark, "input")).select("seq", "sensor_id", "value")


@query(
    "s10_csv_events",
    EVENTS_SQL
    + """SELECT f.seq, f.rule_name, f.result, e.event_type AS sensor, e.value FROM fired f JOIN events e ON e.event_id = f.seq WHERE f.seq % 11 <> 0
    UNION ALL SELECT f.seq, f.rule_name, f.result, NULL, NULL FROM fired f WHERE f.seq % 11 = 0""",
)
def csv_events(spark: SparkSession, folder: str) -> DataFrame:
    where = work_dir(spark, "csv")
    sinks.write_csv(ru.check(event_readings(spark, folder), DEMO), where)
    back = sinks.read_csv(spark, where)
    return back.select("seq", "rule_name", "result", F.explode_outer("sensor_values").alias("sensor", "value"))


@query("s09_event_table", EVENTS_SQL + "SELECT seq, rule_name, result FROM fired")
def event_table(spark: SparkSession, folder: str) -> DataFrame:
    """A day-partitioned event log, written and read back."""
    where = work_dir(spark, "log")
    sinks.write_parquet(ru.check(event_readings(spark, folder), DEMO), where)
    return spark.read.parquet(where).select("seq", "rule_name", "result")
