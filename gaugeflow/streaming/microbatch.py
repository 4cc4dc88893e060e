"""Rules on a stream, one micro-batch at a time, with the batch operators.

Between batches two small tables live in a folder all executors share: the last samples of each
sensor and the rows that still wait for their time. A batch is those plus the new rows, run
through ``check`` with all its layouts, so a sensor that dominates the stream is split like in
batch. Each batch reads the slot of the one before and overwrites the other, and writes its
events under its own number, so a batch that is repeated after a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeflow.functions.timeexpr import Duration
from gaugeflow.model import CheckerConfig, Requirement, Rule, RuleFunction
from gaugeflow.operators import rules as ru
from gaugeflow.operators import windows
from gaugeflow.sources import sinks
from gaugeflow.sources.readings import micros, numbered

READING = "asset string, sensor_id string, ts timestamp, ts_us bigint, seq bigint, value double"
PROGRESS = "batch bigint, frontier bigint, late bigint"


def reach_of(rules: Sequence[Rule | RuleFunction], config: CheckerConfig) -> int:
    """Samples (or microseconds) of history the rules look back to."""
    needs: list[Requirement] = []
    for rule in rules:
        needs += rule.compile()[1] if isinstance(rule, Rule) else list(rule.requirements)
    return max([windows.resolve(r, config).start for r in needs] + [1]) + 1


def _kept(ready: DataFrame, now: int | None, reach: int, config: CheckerConfig) -> DataFrame:
    """The samples that later rows can still look back to, per sensor."""
    samples = ready.where("value is not null")
    newest = W.partitionBy(*windows.KEYS).orderBy(F.desc("ts_us"), F.desc("seq"))
    if config.mode == "samples":  # and as many as tell whether a sensor has answered min_samples times
        ranked = samples.withColumn("_place", F.row_number().over(newest))
        return ranked.where(F.col("_place") <= reach + config.min_samples).drop("_place")
    recent = F.lit(True) if now is None else F.col("ts_us") > now - reach
    older = samples.where(~recent).withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")
    return samples.where(recent).unionByName(older)


def handler(
    rules: Sequence[Rule | RuleFunction],
    folder: str,
    config: CheckerConfig = CheckerConfig(),
    delay: str = "10m",
    align: bool = True,
    fmt: str = "parquet",
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``; events go to ``folder/events``, progress to ``folder/slot*``.

    Rows with no time, or older than what was already answered, are counted as late. With
    ``last`` the rows that still wait are answered too: see ``finish``.
    """
    reach, wait = reach_of(rules, config), Duration.parse(delay).us

    def process(batch: DataFrame, number: int, last: bool = False) -> None:
        spark = batch.sparkSession
        before, after = f"{folder}/slot{(number - 1) % 2}", f"{folder}/slot{number % 2}"
        frontier, late = None, 0
        if number > 0:
            row = spark.read.schema(PROGRESS).json(f"{before}/progress").first()
            if row is None or row["batch"] != number - 1:
                raise RuntimeError(f"no state of batch {number - 1} under {folder}")
            frontier, late = row["frontier"], row["late"]
            history = spark.read.schema(READING).parquet(f"{before}/history")
            waiting = spark.read.schema(READING).parquet(f"{before}/waiting")
        else:
            history = waiting = spark.createDataFrame([], READING)
        columns = history.columns
        rows = batch.withColumn("ts", F.timestamp_micros("ts_us")).select(*columns).persist()
        try:
            answer(rows, number, last, spark, after, frontier, late, history, waiting)
        finally:
            rows.unpersist()

    def answer(rows, number, last, spark, after, frontier, late, history, waiting) -> None:
        in_time = F.col("ts_us").isNotNull() if frontier is None else F.coalesce(F.col("ts_us") > frontier, F.lit(False))
        seen = rows.agg(F.max("ts_us").alias("last"), F.count_if(~in_time).alias("late")).first()
        late += seen["late"]
        reached = [f for f in (frontier, None if seen["last"] is None else seen["last"] - wait) if f is not None]
        now = max(reached) if reached else None

        fresh = waiting.unionByName(rows.where(in_time))
        done = F.lit(True) if last else F.lit(False) if now is None else F.col("ts_us") <= now
        ready = history.unionByName(numbered(fresh.where(done)))
        events = ru.check(ready, rules, config, align)
        if frontier is not None:
            events = events.where(micros(events, "timestamp") > frontier)
        if fmt == "csv":
            sinks.flat(events).write.mode("overwrite").option("header", True).csv(f"{folder}/events/batch={number}")
        else:
            events.write.mode("overwrite").format(fmt).save(f"{folder}/events/batch={number}")

        _kept(ready, now, reach, config).write.mode("overwrite").parquet(f"{after}/history")
        fresh.where(~done).write.mode("overwrite").parquet(f"{after}/waiting")
        # Progress comes last: a slot without it is not taken for a finished batch.
        spark.createDataFrame([(number, now, late)], PROGRESS).coalesce(1).write.mode("overwrite").json(f"{after}/progress")

    return process


def start(readings: DataFrame, rules: Sequence[Rule | RuleFunction], folder: str, trigger: dict | None = None, **options):
    """A running query: canonical readings in, events out under ``folder/events``."""
    return (
        readings.writeStream.foreachBatch(handler(rules, folder, **options))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def finish(spark: SparkSession, rules: Sequence[Rule | RuleFunction], folder: str, **options) -> None:
    """Answer the rows that still wait when a stream has ended; call it once, after its query has stopped."""
    numbers = [row["batch"] for slot in (0, 1) for row in _progress(spark, f"{folder}/slot{slot}/progress")]
    if numbers:
        handler(rules, folder, **options)(spark.createDataFrame([], READING), max(numbers) + 1, last=True)


def _progress(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(PROGRESS).json(path).collect()
    except AnalysisException:  # no such slot yet
        return []
