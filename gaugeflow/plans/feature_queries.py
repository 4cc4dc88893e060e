"""Readings and features over the events table (S1-S3, W1-W22, X1-X4 inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.model import CheckerConfig, Requirement
from gaugeflow.operators import rules as ru
from gaugeflow.operators import windows
from gaugeflow.plans.registry import query, table
from gaugeflow.sources import readings as rd

SENSORS = ["click", "error", "purchase", "signup", "view"]
SAMPLES = CheckerConfig()
CLOCK = CheckerConfig(mode="time")


def event_readings(spark: SparkSession, folder: str, assets: bool = False) -> DataFrame:
    """Events as readings: one sensor per event type, every eleventh value missing."""
    events = table(spark, folder, "events").select(
        "event_type",
        "ts",
        "event_id",
        F.expr("if(event_id % 11 = 0, null, value)").alias("value"),
        (F.col("user_id") % 10).alias("asset"),
    )
    return rd.from_long(events, "event_type", "ts", "value", "asset" if assets else None, "event_id")


def wide_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a frame: one column per event type."""
    value = F.expr("if(event_id % 11 = 0, null, value)")
    return table(spark, folder, "events").select(
        "ts", "event_id", *[F.when(F.col("event_type") == s, value).alias(s) for s in SENSORS]
    )


# The same readings for the statement: n counts the non-null samples of the sensor so far.
READINGS = """
readings AS (
  SELECT event_type AS sensor_id, ts, event_id AS seq,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value,
         epoch_us(ts) AS ts_us
  FROM events),
counted AS (
  SELECT *, count(value) OVER (PARTITION BY sensor_id ORDER BY ts, seq
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
  FROM readings)
"""


def _one(name: str, expression: str, statistic: str | None, sql_value: str, frame: str | None, config: CheckerConfig = SAMPLES):
    """Register a query with one feature of every reading."""
    over = f"{sql_value} OVER (PARTITION BY sensor_id ORDER BY {frame})" if frame else sql_value
    over = f"CASE WHEN n >= {config.min_samples} THEN {over} END" if config.min_samples > 1 else over
    statement = f"WITH {READINGS} SELECT seq, sensor_id, round(CAST({over} AS DOUBLE), 6) AS feature FROM counted"

    @query(name, statement)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        req = Requirement("any", expression, statistic)
        computed = windows.features(event_readings(spark, folder), [req], config)
        return computed.select("seq", "sensor_id", F.round(F.col(f"`{req.series}`"), 6).alias("feature"))


def last(samples: int, end: int = 0) -> str:
    return f"n RANGE BETWEEN {samples + end - 1} PRECEDING AND {end} PRECEDING" if end else (
        f"n RANGE BETWEEN {samples - 1} PRECEDING AND CURRENT ROW"
    )


def clock(start_us: int, end_us: int) -> str:
    return f"ts_us RANGE BETWEEN {start_us - 1} PRECEDING AND {end_us} PRECEDING"


_one("w01_current_value", "0", None, "value", None)
_one("w02_samples_back", "5m", None, "max(value)", "n RANGE BETWEEN 5 PRECEDING AND 5 PRECEDING")
_one("w04_rolling_mean", "10m:", "mean", "avg(value)", last(10))
_one("w05_rolling_variance", "10m:", "variance", "var_samp(value)", last(10))
_one("w06_rolling_std", "10m:", "std", "stddev_samp(value)", last(10))
_one("w07_rolling_sum", "10m:", "sum", "sum(value)", last(10))
_one("w08_rolling_max", "10m:", "max", "max(value)", last(10))
_one("w09_rolling_min", "10m:", "min", "min(value)", last(10))
_one("w10_rolling_abs_max", "10m:", "abs_max", "max(abs(value))", last(10))
_one("w11_rolling_quantile", "10m:", "quantile", "quantile_cont(value, 0.5)", last(10))
_one("w14_rolling_count", "10m:", "count", "count(value)", last(10))
_one("w15_window_with_end_offset", "1h:5m", "max", "max(value)", last(55, 5))
_one("w15_end_offset_ignored", "1h:5m", "max", "max(value)", last(55), CheckerConfig(end_offset="ignore"))
_one("w16_clock_window_mean", "6h:1h", "mean", "avg(value)", clock(21_600_000_000, 3_600_000_000), CLOCK)
_one("w16_clock_window_count", "6h:", "count", "count(value)", clock(21_600_000_000, 0), CLOCK)
for _statistic, _value in (("sum", "sum(value)"), ("max", "max(value)"), ("min", "min(value)"), ("abs_max", "max(abs(value))"), ("std", "stddev_samp(value)"), ("quantile", "quantile_cont(value, 0.5)")):
    _one(f"w16_clock_window_{_statistic}", "6h:1h", _statistic, _value, clock(21_600_000_000, 3_600_000_000), CLOCK)

# Long windows: same answers, another plan.
_one("w04_rolling_mean_long", "3h30m:", "mean", "avg(value)", last(210), CheckerConfig(min_samples=210))
_one("w06_rolling_std_long", "4h:", "std", "stddev_samp(value)", last(240))
_one("w08_rolling_max_long", "5h:1h", "max", "max(value)", last(240, 60))
_one("w11_rolling_quantile_long", "4h:", "quantile", "quantile_cont(value, 0.5)", last(240))


@query(
    "w12_rolling_iqr",
    f"""WITH {READINGS} SELECT seq, sensor_id,
    round(quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w, 6) AS feature
    FROM counted WINDOW w AS (PARTITION BY sensor_id ORDER BY {last(10)})""",
)
def rolling_iqr(spark: SparkSession, folder: str) -> DataFrame:
    req = Requirement("any", "10m:", "iqr")
    return windows.features(event_readings(spark, folder), [req]).select(
        "seq", "sensor_id", F.round(F.col(f"`{req.series}`"), 6).alias("feature")
    )


def _feature(spark: SparkSession, folder: str, expression: str, statistic: str, config: CheckerConfig = SAMPLES, value=None) -> DataFrame:
    req, readings = Requirement("any", expression, statistic), event_readings(spark, folder)
    computed = windows.features(readings if value is None else readings.withColumn("value", value), [req], config)
    return computed.select("seq", "sensor_id", F.round(F.col(f"`{req.series}`"), 6).alias("feature"))


@query(
    "w16_clock_window_iqr",
    f"""WITH {READINGS} SELECT seq, sensor_id, round(quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w, 6) AS feature
    FROM counted WINDOW w AS (PARTITION BY sensor_id ORDER BY {clock(21_600_000_000, 3_600_000_000)})""",
)
def clock_iqr(spark: SparkSession, folder: str) -> DataFrame:
    return _feature(spark, folder, "6h:1h", "iqr", CLOCK)


def _mode(within: str) -> str:
    """The most frequent whole value among the samples b that the condition gives to a reading a; of equal ones the least."""
    return f"""WITH {READINGS}, whole AS (SELECT * REPLACE (floor(value) AS value) FROM counted),
    times AS (SELECT a.seq, b.value, count(*) AS times FROM whole a JOIN whole b ON a.sensor_id = b.sensor_id AND b.value IS NOT NULL AND {within} GROUP BY ALL),
    best AS (SELECT seq, arg_max(value, times * 1e6 - value) AS value FROM times GROUP BY seq)
    SELECT c.seq, c.sensor_id, b.value AS feature FROM counted c LEFT JOIN best b USING (seq)"""


@query("w16_clock_window_mode", _mode("b.ts_us BETWEEN a.ts_us - 21599999999 AND a.ts_us - 3600000000"))
def clock_mode(spark: SparkSession, folder: str) -> DataFrame:
    return _feature(spark, folder, "6h:1h", "mode", CLOCK, F.floor("value").cast("double"))


@query("w13_rolling_mode_long", _mode("b.n BETWEEN a.n - 1439 AND a.n"))
def long_mode(spark: SparkSession, folder: str) -> DataFrame:
    return _feature(spark, folder, "1d:", "mode", value=F.floor("value").cast("double"))


@query(
    "w13_rolling_mode",
    f"""WITH {READINGS},
    pairs AS (
      SELECT a.seq, a.sensor_id, b.value, count(*) AS times
      FROM counted a JOIN counted b
        ON a.sensor_id = b.sensor_id AND b.n BETWEEN a.n - 9 AND a.n AND b.value IS NOT NULL
      GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY times DESC, value) AS place FROM pairs)
    SELECT r.seq, r.sensor_id, best.value AS feature
    FROM readings r LEFT JOIN best ON r.seq = best.seq AND best.place = 1""",
)
def rolling_mode(spark: SparkSession, folder: str) -> DataFrame:
    req = Requirement("any", "10m:", "mode")
    return windows.features(event_readings(spark, folder), [req]).select(
        "seq", "sensor_id", F.col(f"`{req.series}`").alias("feature")
    )


@query(
    "w03_value_at_clock_offset",
    f"""WITH {READINGS}
    SELECT r.seq, r.sensor_id, s.value AS feature
    FROM readings r ASOF LEFT JOIN (SELECT * FROM readings WHERE value IS NOT NULL) s
      ON r.sensor_id = s.sensor_id AND r.ts_us - 1800000000 >= s.ts_us""",
)
def clock_lookback(spark: SparkSession, folder: str) -> DataFrame:
    req = Requirement("any", "30m")
    return windows.features(event_readings(spark, folder), [req], CLOCK).select(
        "seq", "sensor_id", F.col(f"`{req.series}`").alias("feature")
    )


@query(
    "w17_history_cap",
    f"""WITH {READINGS} SELECT seq, sensor_id,
    max(value) OVER (PARTITION BY sensor_id ORDER BY n RANGE BETWEEN 1439 PRECEDING AND 1439 PRECEDING) AS oldest,
    CAST(NULL AS DOUBLE) AS beyond FROM counted""",
)
def history_cap(spark: SparkSession, folder: str) -> DataFrame:
    oldest, beyond = Requirement("any", "1439m"), Requirement("any", "1d")
    return windows.features(event_readings(spark, folder), [oldest, beyond], CheckerConfig(max_history_buffer_size=1440)).select(
        "seq", "sensor_id", F.col(f"`{oldest.series}`").alias("oldest"), F.col(f"`{beyond.series}`").alias("beyond")
    )


@query(
    "w17_no_history_cap",
    f"""WITH {READINGS} SELECT seq, sensor_id,
    max(value) OVER (PARTITION BY sensor_id ORDER BY n RANGE BETWEEN 1440 PRECEDING AND 1440 PRECEDING) AS day,
    max(value) OVER (PARTITION BY sensor_id ORDER BY n RANGE BETWEEN 1500 PRECEDING AND 1500 PRECEDING) AS longer FROM counted""",
)
def no_history_cap(spark: SparkSession, folder: str) -> DataFrame:
    day, longer = Requirement("any", "1d"), Requirement("any", "25h")
    return windows.features(event_readings(spark, folder), [day, longer]).select(
        "seq", "sensor_id", F.col(f"`{day.series}`").alias("day"), F.col(f"`{longer.series}`").alias("longer")
    )


@query(
    "w18_warm_up",
    f"""WITH {READINGS} SELECT seq, sensor_id,
    CASE WHEN n >= 5 THEN round(avg(value) OVER w, 6) END AS settled,
    FROM counted WINDOW w AS (PARTITION BY sensor_id ORDER BY {last(10)})""",
)
def warm_up(spark: SparkSession, folder: str) -> DataFrame:
    req = Requirement("any", "10m:", "mean")
    return windows.features(event_readings(spark, folder), [req], CheckerConfig(min_samples=5)).select(
        "seq", "sensor_id", F.round(F.col(f"`{req.series}`"), 6).alias("settled")
    )


@query(
    "w18_warm_up_zero",
    f"""WITH {READINGS} SELECT seq, sensor_id,
    coalesce(round(var_samp(value) OVER w, 6), 0.0) AS variance
    FROM counted WINDOW w AS (PARTITION BY sensor_id ORDER BY {last(10)})""",
)
def warm_up_zero(spark: SparkSession, folder: str) -> DataFrame:
    req = Requirement("any", "10m:", "variance")
    return windows.features(event_readings(spark, folder), [req], CheckerConfig(warmup="zero")).select(
        "seq", "sensor_id", F.round(F.col(f"`{req.series}`"), 6).alias("variance")
    )


@query(
    "w19_snapshot",
    f"""WITH {READINGS} SELECT seq,
    CASE WHEN value IS NULL THEN '{{}}' ELSE '{{"' || sensor_id || '":' || value || '}}' END AS snapshot FROM readings""",
)
def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return ru.snapshots(event_readings(spark, folder)).select("seq", F.to_json("sensor_values").alias("snapshot"))


MIXED = [
    Requirement("click", "0"),
    Requirement("click", "10m:", "mean"),
    Requirement("view", "10m:", "mean"),
    Requirement("view", "2m"),
    Requirement("nowhere", "0"),
    Requirement("nowhere", "10m:", "max"),
]

# What a wide frame says: every sensor has a row, maybe null, at every moment.
FRAME = """
frame AS (
  SELECT event_id AS seq, ts,
    CASE WHEN event_type = 'click' AND event_id % 11 <> 0 THEN value END AS click,
    CASE WHEN event_type = 'view' AND event_id % 11 <> 0 THEN value END AS view,
    CASE WHEN event_type = 'error' AND event_id % 11 <> 0 THEN value END AS error
  FROM events),
numbered AS (
  SELECT *,
    count(click) OVER (ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_click,
    count(view) OVER (ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_view,
    count(error) OVER (ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_error
  FROM frame),
status AS (
  SELECT seq, ts, click, view, error,
    avg(click) OVER (ORDER BY n_click RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS click_mean,
    avg(view) OVER (ORDER BY n_view RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS view_mean,
    max(view) OVER (ORDER BY n_view RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS view_back,
    max(error) OVER (ORDER BY n_error RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS error_max,
    min(error) OVER (ORDER BY n_error RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS error_min,
    stddev_samp(click) OVER (ORDER BY n_click RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS click_std,
    max(click) OVER (ORDER BY n_click RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS click_back
  FROM numbered)
"""


@query(
    "w22_wide_assembly",
    f"""WITH {FRAME} SELECT seq, click AS click_now, round(click_mean, 6) AS click_mean, round(view_mean, 6) AS view_mean,
    view_back FROM status""",
)
def wide_assembly(spark: SparkSession, folder: str) -> DataFrame:
    status = ru.status_table(event_readings(spark, folder), MIXED[:4])
    return status.select(
        "seq",
        F.col("`click|0`").alias("click_now"),
        F.round("`click|10m:@mean`", 6).alias("click_mean"),
        F.round("`view|10m:@mean`", 6).alias("view_mean"),
        F.col("`view|2m`").alias("view_back"),
    )


@query(
    "w20_absent_sensor",
    f"""WITH {FRAME} SELECT seq, click AS click_now, CAST(NULL AS DOUBLE) AS nowhere_now,
    CAST(NULL AS DOUBLE) AS nowhere_max FROM status""",
)
def absent_sensor(spark: SparkSession, folder: str) -> DataFrame:
    status = ru.status_table(event_readings(spark, folder), [MIXED[0], MIXED[4], MIXED[5]])
    return status.select(
        "seq",
        F.col("`click|0`").alias("click_now"),
        F.col("`nowhere|0`").alias("nowhere_now"),
        F.col("`nowhere|10m:@max`").alias("nowhere_max"),
    )


@query(
    "w21_shared_series",
    f"""WITH {READINGS} SELECT seq, sensor_id, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS peak
    FROM counted WINDOW w AS (PARTITION BY sensor_id ORDER BY {last(10)})""",
)
def shared_series(spark: SparkSession, folder: str) -> DataFrame:
    asked = [Requirement(s, "10m:", stat) for s in SENSORS for stat in ("mean", "max", "mean")]
    return windows.features(event_readings(spark, folder), asked).select(
        "seq", "sensor_id", F.round("`10m:@mean`", 6).alias("mean"), F.col("`10m:@max`").alias("peak")
    )


@query(
    "s01_wide_scan",
    "SELECT event_id AS seq, ts, " + ", ".join(f"CASE WHEN event_type = '{s}' AND event_id % 11 <> 0 THEN value END AS {s}" for s in SENSORS) + " FROM events",
)
def wide_scan(spark: SparkSession, folder: str) -> DataFrame:
    return rd.to_wide(rd.from_wide(wide_events(spark, folder), SENSORS, "ts", seq="event_id"), SENSORS).select("seq", "ts", *SENSORS)


@query(
    "s02_wide_to_long",
    "SELECT seq, sensor_id, value FROM ("
    + " UNION ALL ".join(
        f"SELECT event_id AS seq, '{s}' AS sensor_id, CASE WHEN event_type = '{s}' AND event_id % 11 <> 0 THEN value END AS value FROM events"
        for s in SENSORS
    )
    + ")",
)
def wide_to_long(spark: SparkSession, folder: str) -> DataFrame:
    return rd.from_wide(wide_events(spark, folder), SENSORS, "ts", seq="event_id").select("seq", "sensor_id", "value")


@query(
    "w04_mean_per_asset",
    """WITH readings AS (
      SELECT user_id % 10 AS asset, event_type AS sensor_id, ts, event_id AS seq,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events),
    counted AS (SELECT *, count(value) OVER (PARTITION BY asset, sensor_id ORDER BY ts, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM readings)
    SELECT CAST(asset AS VARCHAR) AS asset, sensor_id, seq, round(avg(value) OVER (
      PARTITION BY asset, sensor_id ORDER BY n RANGE BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS feature FROM counted""",
)
def mean_per_asset(spark: SparkSession, folder: str) -> DataFrame:
    req = Requirement("any", "10m:", "mean")
    computed = windows.features(event_readings(spark, folder, assets=True), [req])
    return computed.select("asset", "sensor_id", "seq", F.round(F.col(f"`{req.series}`"), 6).alias("feature"))


@query(
    "w04_split_ranges",
    f"""WITH {READINGS} SELECT seq, sensor_id, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS peak
    FROM counted WINDOW w AS (PARTITION BY sensor_id ORDER BY {last(10)})""",
)
def split_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The layout for sensors too long for one task, on all sensors."""
    asked = [Requirement("any", "10m:", stat) for stat in ("mean", "max")]
    config = CheckerConfig(layout="split", max_task_rows=20_000)
    return windows.features(event_readings(spark, folder), asked, config).select(
        "seq", "sensor_id", F.round("`10m:@mean`", 6).alias("mean"), F.col("`10m:@max`").alias("peak")
    )


@query(
    "r18_readings_summary",
    f"""WITH {READINGS} SELECT sensor_id, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
    min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
    round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM readings GROUP BY sensor_id""",
)
def readings_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = rd.summary(event_readings(spark, folder))
    return out.select("sensor_id", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
                      *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "max")
