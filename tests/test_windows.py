import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import model
from gaugeflow.model import CheckerConfig, Requirement
from gaugeflow.operators import windows
from gaugeflow.sources import readings as rd

MINUTE = 60_000_000
SCHEMA = "asset string, sensor_id string, ts timestamp, ts_us bigint, seq bigint, value double"
ASKED = [
    Requirement("any", e, s)
    for e, s in [("0", None), ("0m", None), ("3m", None), ("bad", None), ("5m", None), ("5m:10m", "mean"), ("5m:", None), ("1440m", None)]
] + [Requirement("any", e, s) for e in ("4m:", "9m:2m") for s in [*model.STATISTICS, "count", "nothing"]]


def frame(seed):
    """Sensors with runs of nulls, gaps, ties, zeros, negatives; one all null, one with a single row."""
    rng = random.Random(seed)
    rows = []
    for asset, sensor, count in [("", "hot", 300), ("", "cold", 60), ("b", "hot", 40), ("b", "empty", 20), ("b", "one", 1)]:
        ts = 0
        for seq in range(count):
            ts += rng.choice([0, MINUTE, MINUTE, 61 * MINUTE])
            value = float(rng.randint(-3, 3)) if rng.random() < 0.7 else None
            if sensor == "empty" or (sensor == "hot" and 100 < seq < 180):
                value = None
            rows.append({"asset": asset, "sensor_id": sensor, "ts_us": ts, "seq": seq, "value": value})
    return rows


def canonical(spark, rows):
    made = spark.createDataFrame(
        [(r["asset"], r["sensor_id"], r["ts_us"], r["seq"], r["value"]) for r in rows],
        "asset string, sensor_id string, ts_us bigint, seq bigint, value double",
    )
    return made.select("asset", "sensor_id", F.timestamp_micros("ts_us").alias("ts"), "ts_us", "seq", "value")


def collected(df, asked):
    return {(r.asset, r.sensor_id, r.ts_us, r.seq): [r[a.series] for a in asked] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert model.alike(got[key], want[key]), (key, got[key], want[key])


CONFIGS = {
    "plain": CheckerConfig(layout="plain"),
    "blocks": CheckerConfig(layout="plain", wide_window=2),
    "split": CheckerConfig(layout="split", max_task_rows=160),
    "split_blocks": CheckerConfig(layout="split", max_task_rows=120, wide_window=2),
    "hot_only": CheckerConfig(layout="auto", max_task_rows=100),
}


@pytest.mark.parametrize("name", CONFIGS)
def test_against_model(spark, name):
    rows = frame(7)
    got = collected(windows.features(canonical(spark, rows), ASKED, CONFIGS[name]), ASKED)
    same(got, model.features(rows, ASKED))


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitioning_does_not_matter(spark, partitions):
    rows = frame(11)
    df = canonical(spark, rows).repartition(partitions)
    same(collected(windows.features(df, ASKED, CONFIGS["blocks"]), ASKED), model.features(rows, ASKED))


def test_clock_mode_split_equals_plain(spark):
    asked = [Requirement("any", "0"), Requirement("any", "3m"), Requirement("any", "2h"), Requirement("any", "90m:", "mean"), Requirement("any", "2h:1h", "count")]
    df = canonical(spark, frame(3))
    plain = collected(windows.features(df, asked, CheckerConfig(mode="time", layout="plain")), asked)
    split = collected(windows.features(df, asked, CheckerConfig(mode="time", layout="split")), asked)
    assert plain.keys() == split.keys() and all(model.alike(plain[k], split[k]) for k in plain)


def test_clock_lookback_sees_past_gaps(spark):
    rows = [{"asset": "", "sensor_id": "s", "ts_us": t * MINUTE, "seq": 0, "value": float(t)} for t in (0, 1, 500, 1000)]
    asked = [Requirement("any", "3m")]
    for layout in ("plain", "split"):
        got = collected(windows.features(canonical(spark, rows), asked, CheckerConfig(mode="time", layout=layout)), asked)
        assert [got["", "s", t * MINUTE, 0][0] for t in (0, 1, 500, 1000)] == [None, None, 1.0, 500.0]


def test_warm_up_and_minimum(spark):
    rows = [{"asset": "", "sensor_id": "s", "ts_us": t, "seq": 0, "value": float(t)} for t in range(4)]
    asked = [Requirement("any", "3m:", "variance")]
    df = canonical(spark, rows)

    def answers(**config):
        got = collected(windows.features(df, asked, CheckerConfig(layout="plain", **config)), asked)
        return [got["", "s", t, 0][0] for t in range(4)]

    assert answers() == [None, 0.5, 1.0, 1.0]
    assert answers(warmup="zero") == [0.0, 0.5, 1.0, 1.0]
    assert answers(min_samples=3) == [None, None, 1.0, 1.0]


def test_wide_and_long_input_agree(spark):
    wide = spark.createDataFrame([(i, float(i), None if i % 3 else float(-i)) for i in range(30)], "t bigint, a double, b double")
    wide = wide.select(F.timestamp_micros(F.col("t") * MINUTE).alias("ts"), "a", "b")
    long = wide.unpivot("ts", ["a", "b"], "sensor_id", "value")
    asked = [Requirement("any", "4m:", "mean")]
    one = collected(windows.features(rd.from_wide(wide), asked), asked)
    two = collected(windows.features(rd.from_long(long), asked), asked)
    assert one == two and len(one) == 60


def test_nan_and_text_timestamps(spark):
    df = spark.createDataFrame([("s", "2024-01-01 00:00:00", float("nan")), ("s", "2024-01-01 00:01:00", 1.0)], "sensor_id string, ts string, value double")
    rows = rd.from_long(df).orderBy("ts_us").collect()
    assert [r.value for r in rows] == [None, 1.0] and rows[1].ts_us - rows[0].ts_us == MINUTE


@pytest.mark.parametrize("statistic", ["mean", "std", "variance", "sum", "max", "min", "abs_max", "count", "quantile", "iqr", "mode"])
def test_clock_windows_in_buckets_of_rows(spark, statistic):
    """Bursts, gaps, ties of one instant and nulls; every layout against looking at each window by itself."""
    rng = random.Random(11)
    data, at = [], 0
    for seq in range(700):
        at += rng.choice([0, 0, 0, 1, 1, 7, 400 if rng.random() < 0.1 else 2])
        data.append(("", "a", at * 1_000_000, seq, rng.choice([None, 1e9]) if rng.random() < 0.05 else float(rng.randint(0, 6))))
    df = spark.createDataFrame(data, "asset string, sensor_id string, ts_us bigint, seq bigint, value double").withColumn("ts", F.timestamp_micros("ts_us"))
    asked = [Requirement("a", "60s:", statistic), Requirement("a", "300s:20s", statistic), Requirement("a", "3s:", statistic), Requirement("a", "45s"), Requirement("a", "0")]

    def over(low, high):
        w = np.array([v for *_, t, _, v in data if low <= t <= high and v is not None])
        if not len(w):
            return 0.0 if statistic == "count" else None
        mode = min(set(w), key=lambda v: (-(w == v).sum(), v))
        return {
            "mean": w.mean(), "std": w.std(ddof=1) if len(w) > 1 else None, "variance": w.var(ddof=1) if len(w) > 1 else None, "sum": w.sum(), "max": w.max(), "min": w.min(),
            "abs_max": np.abs(w).max(), "count": len(w), "quantile": np.quantile(w, 0.5), "iqr": np.quantile(w, 0.75) - np.quantile(w, 0.25), "mode": mode,
        }[statistic]

    def back(t):
        held = [(x, s, v) for *_, x, s, v in data if x <= t - 45_000_000 and v is not None]
        return max(held)[2] if held else None

    want = {s: [over(t - 59_999_999, t), over(t - 299_999_999, t - 20_000_000), over(t - 2_999_999, t), back(t), v] for *_, t, s, v in data}
    for config in (CheckerConfig(mode="time"), CheckerConfig(mode="time", layout="split", max_task_rows=100), CheckerConfig(mode="time", layout="split", max_task_rows=2000)):
        got = {r.seq: [r[a.series] for a in asked] for r in windows.features(df, asked, config).collect()}
        assert got.keys() == want.keys()
        for seq in want:
            assert all((g is None) == (w is None) and (g is None or abs(g - w) <= 1e-6 * max(1.0, abs(w))) for g, w in zip(got[seq], want[seq])), (config, seq, got[seq], want[seq])


@pytest.mark.parametrize("config", [CheckerConfig(), CheckerConfig(layout="split", max_task_rows=300)])
def test_long_mode(spark, config):
    rng = random.Random(12)
    data = [("", "a", s * 1_000_000, s, None if rng.random() < 0.1 else float(rng.randint(0, 9))) for s in range(900)]
    df = spark.createDataFrame(data, "asset string, sensor_id string, ts_us bigint, seq bigint, value double").withColumn("ts", F.timestamp_micros("ts_us"))
    asked = Requirement("a", "200m:", "mode")
    got = {r.seq: r[asked.series] for r in windows.features(df, [asked], config).collect()}
    seen = []
    for *_, seq, value in data:
        seen += [] if value is None else [value]
        last = seen[-200:]
        assert got[seq] == (min(set(last), key=lambda v: (-last.count(v), v)) if last else None)


def test_rows_of_a_silent_sensor_are_not_one_task(spark):
    # one sensor without a sample, one with a single one: all their rows have the same n
    rows = spark.range(6000).select(F.explode(F.array(F.lit("never"), F.lit("once"))).alias("sensor_id"), "id", F.timestamp_seconds("id").alias("ts"))
    rows = rows.withColumn("value", F.when((F.col("sensor_id") == "once") & (F.col("id") == 700), F.lit(3.0)))
    readings = rd.from_long(rows, seq="id")
    asked = [Requirement("any", "0"), Requirement("any", "10m:", "max"), Requirement("any", "10m:", "count")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = windows.features(readings, asked, CheckerConfig(layout="split", max_task_rows=2000))
        plain = windows.features(readings, asked, CheckerConfig(layout="plain"))
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
        tasks = found.where("value is null").withColumn("task", F.spark_partition_id()).groupBy("task").count()
        assert tasks.agg(F.max("count")).first()[0] < 6000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
