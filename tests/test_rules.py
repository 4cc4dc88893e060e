import pytest
from pyspark.sql import functions as F

from gaugeflow.model import CheckerConfig, Requirement, Rule, RuleFunction
from gaugeflow.operators import rules as ru
from gaugeflow.operators import windows
from gaugeflow.operators.rules import truthy
from gaugeflow.sources import readings as rd

DEMO = [
    Rule("high_temp_alert", lambda s: truthy(s.get("temp", "0")) & (s.get("temp", "0") > 90), "high_temperature_alert", "too hot"),
    Rule("sustained_high_pressure", lambda s: truthy(s.get("pressure", "5m:", "mean")) & (s.get("pressure", "5m:", "mean") > 14.0), "sustained"),
    Rule("pressure_spike", lambda s: truthy(s.get("pressure", "10m:", "max")) & (s.get("pressure", "10m:", "max") > 15.0), "spike"),
]


@pytest.fixture(scope="module")
def plant(spark):
    """500 minutes of two sensors with the violations of the demo."""
    i = F.col("id")
    temp = F.when(i.between(100, 110), 95.0).otherwise(85.0 + F.sin(i) * 2)
    pressure = F.when(i.between(200, 210), 14.5).when(i == 350, 16.0).otherwise(13.0 + F.cos(i) * 0.5)
    wide = spark.range(500).select(F.timestamp_seconds(1704067200 + i * 60).alias("ts"), temp.alias("temp"), pressure.alias("pressure"))
    return rd.from_wide(wide)


def minutes(events, name):
    rows = events.where(F.col("rule_name") == name).select(((F.unix_seconds("timestamp") - 1704067200) / 60).cast("int").alias("m")).collect()
    return sorted(r.m for r in rows)


@pytest.mark.parametrize("config", [CheckerConfig(), CheckerConfig(layout="split", max_task_rows=200), CheckerConfig(mode="time")])
def test_demo_scenario(plant, config):
    events = ru.check(plant, DEMO, config)
    assert minutes(events, "high_temp_alert") == list(range(100, 111))
    assert minutes(events, "pressure_spike") == list(range(350, 360))
    # Five samples average over 14 from the fourth violation on, and two samples beyond its end.
    sustained = minutes(events, "sustained_high_pressure")
    assert set(range(204, 211)) <= set(sustained) <= set(range(202, 214))
    first = events.where("rule_name = 'high_temp_alert'").orderBy("timestamp").first()
    assert first.triggered and first.result == "high_temperature_alert" and first.rule_description == "too hot"
    assert first.explanation == "Rule 'high_temp_alert' returned: high_temperature_alert"
    assert first.sensor_values["temp"] == 95.0 and set(first.sensor_values) == {"temp", "pressure"}


def test_zero_is_false_unless_told_otherwise(spark):
    readings = rd.from_wide(spark.sql("SELECT timestamp_seconds(id) AS ts, double(id) AS s FROM range(3)"))
    for guard, want in (("nonzero", 1), ("not_null", 2)):
        rule = Rule("low", lambda s, g=guard: truthy(s.get("s", "0"), g) & (s.get("s", "0") < 2), "low")
        assert ru.check(readings, [rule]).count() == want


def test_missing_sensor_and_missing_data(spark):
    readings = rd.from_wide(spark.sql("SELECT timestamp_seconds(id) AS ts, IF(id = 1, NULL, double(id)) AS s FROM range(3)"))
    gone = Rule("gone", lambda s: s.get("nowhere", "0") > 0, "never")
    both = Rule("both", lambda s: (s.get("s", "0") >= 0) & s.get("nowhere", "0").isNull(), "seen")
    assert ru.check(readings, [gone]).count() == 0
    assert ru.check(readings, [both]).count() == 2
    status = ru.status_table(readings, [Requirement("s", "0")])
    errors = ru.rule_errors(status, [Rule("r", lambda s: s.get("s", "0") > 0, "x")]).collect()
    assert [(e.rule_name, e.missing) for e in errors] == [("r", ["s|0"])]


def test_functions(spark):
    readings = rd.from_wide(spark.sql("SELECT timestamp_seconds(id) AS ts, double(id) AS s FROM range(4)"))
    asked = (Requirement("s", "0"),)
    rules = [
        RuleFunction("false_fires", lambda st: False if st.get("s", "0") == 2 else None, asked),
        RuleFunction("raises", lambda st: 1 / st.get("s", "0") and None, asked),
        RuleFunction("undeclared", lambda st: st.get("s", "5m:", "mean"), asked),
    ]
    events = ru.check(readings, rules, snapshot=False).collect()
    assert [(e.rule_name, e.result) for e in events] == [("false_fires", "False")]
    errors = ru.function_errors(ru.status_table(readings, asked), rules).collect()
    assert [e.rule_name for e in errors] == ["raises"] and "ZeroDivisionError" in errors[0].error


def test_registered_functions_only(spark):
    loaded = spark.createDataFrame([("known",), ("unknown",)], "rule_name string")
    known = RuleFunction("known", lambda st: None, (Requirement("s", "0"),))
    assert ru.from_rule_table(loaded, {"known": known}) == [known]


def test_rule_rows_equal_rules(plant, spark):
    rows = spark.createDataFrame(
        [
            (1, "hot", "temp", "0", None, ">", 90.0, "hot"),
            (2, "both", "temp", "0", None, ">", 86.0, "both"),
            (2, "both", "pressure", "5m:", "mean", ">=", 13.1, "both"),
            (2, "both", "pressure", "0", None, "<", 13.4, "both"),
        ],
        "rule_id bigint, rule_name string, sensor_id string, time_expression string, statistic string, op string, threshold double, result string",
    )
    rules = [
        Rule("hot", lambda s: truthy(s.get("temp", "0")) & (s.get("temp", "0") > 90), "hot"),
        Rule(
            "both",
            lambda s: (s.get("temp", "0") > 86) & (s.get("pressure", "5m:", "mean") >= 13.1) & (s.get("pressure", "0") < 13.4),
            "both",
        ),
    ]
    key = lambda df: sorted((r.timestamp, r.rule_name, r.result, tuple(sorted(r.sensor_values.items()))) for r in df.collect())
    assert key(ru.check_rows(plant, rows)) == key(ru.check(plant, rules)) != []


def test_many_rules(plant):
    rules = [Rule(f"over_{t}", lambda s, t=t: s.get("temp", "0") > 80 + t / 20, "over") for t in range(250)]
    found = {r.rule_name: r.events for r in ru.events_per_rule(ru.check(plant, rules, snapshot=False)).collect()}
    values = [r.value for r in plant.where("sensor_id = 'temp'").collect()]
    want = {f"over_{t}": sum(v > 80 + t / 20 for v in values) for t in range(250)}
    assert found == {k: v for k, v in want.items() if v}


def test_many_rules_compute_features_once(spark, data):
    readings = rd.from_long(spark.read.parquet(f"{data}/events.parquet"), "event_type", "ts", "value", seq="event_id")
    rules = [Rule(f"r{i}", (lambda k: lambda status: status.get("view", "5m:", "mean") > k)(i), "hit") for i in range(350)]
    plan = ru.check(readings, rules, snapshot=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and plan.count("Union") == 0  # one for the row counts of sensors at most


def test_no_rules_give_no_events(spark):
    readings = rd.from_long(spark.createDataFrame([("a", 1, 2.0)], "sensor_id string, ts int, value double").selectExpr("sensor_id", "timestamp_seconds(ts) AS ts", "value"))
    none = spark.createDataFrame([], "rule_id bigint, rule_name string, sensor_id string, time_expression string, statistic string, op string, threshold double, result string")
    for got in (ru.check(readings, []), ru.check_rows(readings, none), ru.check(readings, [], snapshot=False)):
        assert got.columns == ru.EVENT and got.count() == 0


def test_readings_of_one_instant_stay_apart(spark):
    rows = spark.createDataFrame([("a", 60, 5.0), ("a", 60, 9.0), ("b", 60, 1.0), ("a", 120, 7.0)], "sensor_id string, ts int, value double")
    readings = rd.from_long(rows.selectExpr("sensor_id", "timestamp_seconds(ts) AS ts", "value"))
    assert rd.repeated(readings).count() == 0
    low = Rule("low", lambda status: status.get("a", "0") < 8, "low")
    for align in (True, False):
        assert sorted(r.seq for r in ru.check(readings, [low], align=align).collect()) == [0, 0]
    both = Rule("both", lambda status: (status.get("a", "0") > 0) & (status.get("a", "10m:", "count") == 2), "x")
    assert ru.check(readings, [both]).count() == 1
    named = rd.from_long(rows.selectExpr("sensor_id", "timestamp_seconds(ts) AS ts", "value", "0 AS s"), seq="s")
    assert [(r.sensor_id, r.readings) for r in rd.repeated(named).collect()] == [("a", 2)]


def test_lookbacks_have_no_bound_unless_asked(spark):
    rows = spark.range(3000).selectExpr("'a' AS sensor_id", "timestamp_seconds(id * 60) AS ts", "CAST(id AS DOUBLE) AS value")
    req = Requirement("a", "2d")
    got = windows.features(rd.from_long(rows), [req]).where("value = 2999").first()
    assert got[req.series] == 2999 - 2880
    bound = windows.features(rd.from_long(rows), [req], CheckerConfig(max_history_buffer_size=1440)).where("value = 2999").first()
    assert bound[req.series] is None
