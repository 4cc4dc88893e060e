import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from model import alike

from gaugeflow.model import CheckerConfig, Requirement, Rule
from gaugeflow.operators import rules as ru
from gaugeflow.operators import sliding, windows
from gaugeflow.sources import readings as rd
from gaugeflow.streaming import microbatch, stateful

MINUTE = 60_000_000


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of a stateful stream is a store of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SCHEMA = "asset string, sensor_id string, ts_us bigint, seq bigint, value double"
RULES = [
    Rule("high", lambda s: s.get("a", "0") > 7, "high"),
    Rule("mixed", lambda s: (s.get("a", "5m:", "mean") > 4) & (s.get("b", "8m:2m", "max") > 6), "mixed"),
]
ASKED = [Requirement("a", "0"), Requirement("a", "5m:", "mean"), Requirement("b", "8m:2m", "max"), Requirement("b", "3m"), Requirement("a", "6m:", "iqr"), Requirement("b", "4m:", "mode"), Requirement("b", "4m:", "std"), Requirement("a", "4m:", "count")]


def rows(count=120, seed=5):
    rng = random.Random(seed)
    out = []
    for minute in range(1, count):
        for asset in ("x", "y"):
            for sensor in ("a", "b"):
                if rng.random() < 0.8:
                    out.append((asset, sensor, minute * MINUTE, 0, float(rng.randint(0, 9)) if rng.random() < 0.8 else None))
    return out


def batches(spark, tmp_path, data, count=6, late=()):
    """Files in order of time, shuffled by up to five minutes; ``late`` rows come with the last but one."""
    rng = random.Random(1)
    arriving = sorted(data, key=lambda r: r[2] + rng.randint(0, 5) * MINUTE)
    size = -(-len(arriving) // count)
    parts = [arriving[i : i + size] for i in range(0, len(arriving), size)]
    parts[-2] = parts[-2] + list(late)
    folder = tmp_path / "in"
    for number, part in enumerate(parts):
        frame = spark.createDataFrame(part, SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(str(folder / f"part={number}"))
    return folder


def stream(spark, folder):
    df = (
        spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    )
    return df.select("asset", "sensor_id", F.timestamp_micros("ts_us").alias("ts"), "ts_us", "seq", "value")


def batch(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return df.select("asset", "sensor_id", F.timestamp_micros("ts_us").alias("ts"), "ts_us", "seq", "value")


def test_state_equals_batch(spark, tmp_path):
    data = rows()
    late = [("x", "a", 3 * MINUTE, 99, 1000.0)]
    out = stateful.status_stream(stateful.timed(stream(spark, batches(spark, tmp_path, data, late=late))), ASKED, delay="10 minutes")
    query = out.writeStream.format("memory").queryName("status_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    got = {(r.asset, r.ts_us, r.seq): [r[a.name] for a in ASKED] for r in spark.table("status_out").collect()}
    full = ru.status_table(batch(spark, data), ASKED).collect()
    frontier = max(r[2] for r in data) - 10 * MINUTE
    want = {(r.asset, r.ts_us, r.seq): [r[a.name] for a in ASKED] for r in full if r.ts_us <= frontier}
    assert dropped == 1 and got.keys() == want.keys()
    for key in want:
        assert alike(got[key], want[key]), key


def test_state_by_sensor_equals_batch(spark, tmp_path):
    data = rows(seed=8)
    asked = [Requirement("any", "0"), Requirement("any", "5m:", "mean"), Requirement("any", "2m")]
    out = stateful.status_stream(stateful.timed(stream(spark, batches(spark, tmp_path, data))), asked, delay="10 minutes", by_sensor=True)
    out.writeStream.format("memory").queryName("sensor_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.asset, r.sensor_id, r.ts_us): [r[a.series] for a in asked] for r in spark.table("sensor_out").collect()}
    frontier = max(r[2] for r in data) - 10 * MINUTE
    full = windows.features(batch(spark, data), asked).collect()
    want = {(r.asset, r.sensor_id, r.ts_us): [r[a.series] for a in asked] for r in full if r.ts_us <= frontier}
    assert got.keys() == want.keys() and all(alike(got[k], want[k]) for k in want)


def test_microbatches_equal_batch(spark, tmp_path):
    data = rows(seed=9)
    late = [("x", "a", 3 * MINUTE, 99, 1000.0)]
    source = stream(spark, batches(spark, tmp_path, data, count=4, late=late))
    where = str(tmp_path / "work")
    microbatch.start(source, RULES, where, delay="10m").awaitTermination()
    key = lambda df: sorted((r.asset, r.timestamp, r.rule_name, tuple(sorted(r.sensor_values.items()))) for r in df.collect())
    frontier = max(r[2] for r in data) - 10 * MINUTE
    want = ru.check(batch(spark, data), RULES).where(F.unix_micros("timestamp") <= frontier)
    assert key(spark.read.parquet(f"{where}/events")) == key(want) != []
    progress = spark.read.json(f"{where}/slot1/progress").first()
    assert progress.batch == 3 and progress.late == 1 and progress.frontier == frontier


def test_repeated_batch_changes_nothing(spark, tmp_path):
    data = rows(count=40)
    handle = microbatch.handler(RULES, str(tmp_path), delay="5m")
    parts = [batch(spark, [r for r in data if (r[2] < 20 * MINUTE) == first]) for first in (True, False)]
    handle(parts[0], 0)
    handle(parts[1], 1)
    once = spark.read.parquet(f"{tmp_path}/events").count()
    handle(parts[1], 1)
    assert spark.read.parquet(f"{tmp_path}/events").count() == once
    with pytest.raises(RuntimeError):
        handle(parts[1], 5)


def test_state_equals_batch_for_every_statistic_and_min_samples(spark, tmp_path):
    data = [r for r in rows(60) if r[0] == "x"]
    data[20] = (*data[20][:4], 1e9)  # a sum kept running would not forget it
    statistics = ["mean", "std", "variance", "sum", "max", "min", "abs_max", "count", "quantile", "iqr", "mode"]
    asked = [Requirement(*where, statistic) for statistic in statistics for where in (("a", "5m:"), ("b", "9m:2m"))]
    config = CheckerConfig(min_samples=20)
    beats = str(tmp_path / "beats")
    readings = stream(spark, batches(spark, tmp_path, data)).unionByName(stateful.heartbeats(spark, beats))
    out = stateful.status_stream(stateful.timed(readings), asked, config, delay="10 minutes")
    for _ in range(2):
        query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o"))
        query.trigger(availableNow=True).start().awaitTermination()
        stateful.close(spark, beats)
    got = spark.read.parquet(str(tmp_path / "o"))
    want = ru.status_table(batch(spark, data), asked, config)
    names = ["asset", "ts_us", "seq", *[r.name for r in asked]]
    pick = lambda df: sorted(tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    assert len(pick(got)) == want.count() and [str(r) for r in pick(got)] == [str(r) for r in pick(want)]


@pytest.mark.parametrize("cuts", [[], [1500], [3, 40, 41, 700, 2900]])
def test_batches_of_many_samples_and_kept_pages(cuts):
    rng, config = random.Random(2), CheckerConfig(min_samples=5)
    now = np.array([np.nan if rng.random() < 0.2 else float(rng.randint(0, 50)) for _ in range(3000)])
    asked = [("0", None), ("700m", None), ("9m:", "mean"), ("400m:", "max"), ("900m:600m", "std"), ("350m:10m", "quantile"), ("50m:", "mode"), ("3m:", "count")]
    series = [windows.resolve(Requirement("a", *a), config) for a in asked]
    store, told = {}, []
    for a, b in zip([0, *cuts], [*cuts, 3000]):
        pages = sliding.Pages(store.get)
        told.append(stateful._Sensor(pages, series, config).advance(now[a:b]))
        for key, page in pages.changes():
            store.pop(key) if page is None else store.__setitem__(key, page)
    samples, seen = now[~np.isnan(now)], np.cumsum(~np.isnan(now))
    for s, answer in zip(series, map(np.concatenate, zip(*told))):
        if s.kind == "current":
            want = now
        else:
            base = samples if s.kind == "lookback" else sliding.one_by_one(samples, s.start - s.end, s.statistic, 0.5)
            place = seen - 1 - s.end
            known = (place >= 0) & ((s.kind == "lookback") | (seen >= 5 + s.end))
            want = np.where(known, base[np.maximum(place, 0)], np.nan)
        assert np.allclose(answer, want, equal_nan=True), s
    assert sum(map(len, store.values())) < 12_000


def test_state_refuses_the_clock(spark, tmp_path):
    with pytest.raises(ValueError):
        stateful.status_stream(stateful.timed(batch(spark, rows(3))), ASKED, CheckerConfig(mode="time"))


@pytest.mark.parametrize("config", [CheckerConfig(min_samples=20), CheckerConfig(mode="time"), CheckerConfig(mode="time", min_samples=1, end_offset="ignore")])
def test_micro_batches_equal_batch_to_the_last_row(spark, tmp_path, config):
    data = rows(60)
    folder = str(tmp_path / "out")
    source = stream(spark, batches(spark, tmp_path, data, count=4))
    microbatch.start(source, RULES, folder, config=config, delay="10m").awaitTermination()
    microbatch.finish(spark, RULES, folder, config=config, delay="10m")
    pick = lambda df: sorted((r.asset, str(r.timestamp), r.seq, r.rule_name) for r in df.collect())
    want = pick(ru.check(batch(spark, data), RULES, config))
    assert want and pick(spark.read.parquet(f"{folder}/events")) == want


def test_rows_without_a_time_are_counted(spark, tmp_path):
    folder = str(tmp_path)
    process = microbatch.handler(RULES, folder, delay="1m")
    data = batch(spark, [("x", "a", MINUTE, 0, 1.0), ("x", "a", None, 0, 1.0)])
    process(data, 0)
    assert spark.read.schema(microbatch.PROGRESS).json(f"{folder}/slot0/progress").first().late == 1


@pytest.fixture
def one_instant(spark, tmp_path):
    """Readings without a seq, several of a sensor at one instant, in different files: as a stream and as a batch."""
    rng = random.Random(3)
    data = [(a, s, m * MINUTE, 0, None if rng.random() < 0.1 else float(rng.randint(0, 9))) for m in range(1, 40) for a in "xy" for s in "ab" for _ in range(rng.randint(0, 3))]
    frame = stream(spark, batches(spark, tmp_path, data, count=4)).drop("seq", "ts_us")
    return rd.from_long(frame, asset="asset"), rd.from_long(batch(spark, data).drop("seq", "ts_us"), asset="asset")


def test_state_keeps_every_reading_of_one_instant(spark, tmp_path, one_instant):
    asked = [Requirement("a", "0"), Requirement("a", "5m:", "sum"), Requirement("b", "4m:", "count"), Requirement("b", "2m")]
    beats = str(tmp_path / "beats")
    out = stateful.status_stream(stateful.timed(one_instant[0].unionByName(stateful.heartbeats(spark, beats))), asked, delay="10 minutes")
    for _ in range(2):
        query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o"))
        query.trigger(availableNow=True).start().awaitTermination()
        stateful.close(spark, beats)
    pick = lambda df: sorted(map(str, df.select("asset", "ts_us", F.col("seq").cast("bigint"), *[f"`{r.name}`" for r in asked]).collect()))
    want = ru.status_table(one_instant[1], asked)
    assert want.where("seq = 2").count() and pick(spark.read.parquet(str(tmp_path / "o"))) == pick(want)


def test_micro_batches_keep_every_reading_of_one_instant(spark, tmp_path, one_instant):
    folder = str(tmp_path / "out")
    microbatch.start(one_instant[0], RULES, folder, delay="10m").awaitTermination()
    microbatch.finish(spark, RULES, folder, delay="10m")
    pick = lambda df: sorted((r.asset, str(r.timestamp), r.seq, r.rule_name, str(sorted(r.sensor_values.items()))) for r in df.collect())
    want = pick(ru.check(one_instant[1], RULES))
    assert any(r[2] == 2 for r in want) and pick(spark.read.parquet(f"{folder}/events")) == want


def test_wide_stream_without_seq_is_refused(spark, tmp_path):
    spark.range(1).selectExpr("timestamp_seconds(id) AS ts", "1.0 AS a").write.parquet(str(tmp_path / "w"))
    with pytest.raises(ValueError):
        rd.from_wide(rd.stream(spark, str(tmp_path / "w"), "ts timestamp, a double"))


@pytest.mark.parametrize("align", [True, False])
def test_rule_stream_equals_batch(spark, tmp_path, align):
    data = rows(60)
    rules = RULES if align else [RULES[0], Rule("low", lambda s: s.get("b", "4m:", "min") < 2, "low")]
    beats = str(tmp_path / "beats")
    out = stateful.rule_stream(stream(spark, batches(spark, tmp_path, data)).unionByName(stateful.heartbeats(spark, beats)), rules, delay="10 minutes", align=align)
    for _ in range(2):
        query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o"))
        query.trigger(availableNow=True).start().awaitTermination()
        stateful.close(spark, beats)
    pick = lambda df: sorted((r.asset, str(r.timestamp), r.seq, r.rule_name, r.result) for r in df.collect())
    want = pick(ru.check(batch(spark, data), rules, align=align))
    assert want and pick(spark.read.parquet(str(tmp_path / "o"))) == want


class Held(dict):
    """State of one key, and the handle that gives it out."""

    getMapState = getValueState = lambda self, name, *schemas: self.setdefault(name, Held())
    getValue = dict.get
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__
    registerTimer = deleteTimer = lambda self, at: None
    exists = lambda self: "now" in self
    update = lambda self, value: self.__setitem__("now", value)
    get = lambda self: self["now"]
    clear = lambda self: self.pop("now", None)


class Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_key_is_answered_some_rows_at_a_time(monkeypatch):
    monkeypatch.setattr(stateful, "PARCEL_ROWS", 16)
    asked = [Requirement("any", "0"), Requirement("any", "10m:", "max")]
    plan = [(r.series, r.sensor_id, windows.resolve(r, CheckerConfig())) for r in asked]
    at = np.random.default_rng(2).permutation(3000)
    frame = pd.DataFrame({"ts_us": at * 500, "seq": 0, "sensor_id": "s", "value": (at * 7 % 1001).astype(float)})  # two rows a millisecond

    def told(run_rows):
        state = Held()
        rolling = stateful._Rolling(plan, ["asset", "sensor_id"], CheckerConfig(), run_rows)
        rolling.init(state)
        list(rolling.handleInputRows(("", "s"), (frame.iloc[a : a + 100] for a in range(0, 3000, 100)), None))
        return [part for ms in (700, 5000) for part in rolling.handleExpiredTimer(("", "s"), Watermark(ms), None)], state

    (whole, _), (parts, state) = told(1 << 20), told(200)
    assert len(whole) == 2 and len(parts) > 4 and max(map(len, parts)) < 600 and not state["waiting"]
    pd.testing.assert_frame_equal(pd.concat(whole, ignore_index=True), pd.concat(parts, ignore_index=True))
    assert len(pd.concat(parts)) == 3000


def test_state_in_small_runs_equals_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "RUN_ROWS", 7)
    test_state_by_sensor_equals_batch(spark, tmp_path)
