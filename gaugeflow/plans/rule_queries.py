"""Rules over the events table (R1-R19, S7-S10)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.model import CheckerConfig, Requirement, Rule, RuleFunction
from gaugeflow.operators import rules as ru
from gaugeflow.operators.rules import truthy
from gaugeflow.plans.feature_queries import FRAME, event_readings
from gaugeflow.plans.catalog_queries import RULES
from gaugeflow.plans.registry import derived, plain, query, table
from gaugeflow.sources import rules as sr

HIGH = Rule("high_click_alert", lambda s: truthy(s.get("click", "0")) & (s.get("click", "0") > 120), "high_click", "Click above 120")
SUSTAINED = Rule(
    "sustained_view", lambda s: truthy(s.get("view", "10m:", "mean")) & (s.get("view", "10m:", "mean") > 70), "sustained_view_alert",
    "Mean of ten views above 70",
)
SPIKE = Rule(
    "error_spike", lambda s: truthy(s.get("error", "10m:", "max")) & (s.get("error", "10m:", "max") > 200), "error_spike_detected",
    "Error above 200 in ten samples",
)
STABILITY = Rule("click_stability", lambda s: truthy(s.get("click", "10m:", "std")) & (s.get("click", "10m:", "std") > 60), "click_unstable")
BOTH = Rule(
    "click_over_mean",
    lambda s: truthy(s.get("click", "0")) & truthy(s.get("click", "10m:", "mean")) & (s.get("click", "0") > 90) & (s.get("click", "10m:", "mean") > 60),
    "click_over_mean",
)
DEVIATION = Rule(
    "click_disturbance",
    lambda s: truthy(s.get("click", "0"))
    & truthy(s.get("click", "10m:", "mean"))
    & (F.try_divide(F.abs(s.get("click", "0") - s.get("click", "10m:", "mean")), s.get("click", "10m:", "mean")) > 1.5),
    "click_disturbance",
)
CHANGE = Rule("click_rate", lambda s: s.get("click", "0") - s.get("click", "1m") > 100, "click_rate_of_change")
ABOVE = Rule("error_sustained", lambda s: s.get("error", "3m:", "min") > 60, "error_sustained_above")
TOGETHER = Rule(
    "view_and_error", lambda s: (s.get("view", "10m:", "mean") > 55) & (s.get("error", "10m:", "max") > 150), "view_and_error_high"
)
DEMO = [HIGH, SUSTAINED, SPIKE]

CONDITION = {
    "high_click_alert": "click <> 0 AND click > 120",
    "sustained_view": "view_mean <> 0 AND view_mean > 70",
    "error_spike": "error_max <> 0 AND error_max > 200",
    "click_stability": "click_std <> 0 AND click_std > 60",
    "click_over_mean": "click <> 0 AND click_mean <> 0 AND click > 90 AND click_mean > 60",
    "click_disturbance": "click <> 0 AND click_mean <> 0 AND abs(click - click_mean) / click_mean > 1.5",
    "click_rate": "click - click_back > 100",
    "error_sustained": "error_min > 60",
    "view_and_error": "view_mean > 55 AND error_max > 150",
}


def _statement(rules: list[Rule]) -> str:
    parts = [
        f"SELECT seq, ts AS timestamp, '{r.name}' AS rule_name, '{r.result}' AS result FROM status WHERE {CONDITION[r.name]}" for r in rules
    ]
    return f"WITH {FRAME} " + " UNION ALL ".join(parts)


def _rules(name: str, rules: list[Rule]) -> None:
    @query(name, _statement(rules))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = ru.check(event_readings(spark, folder), rules, snapshot=False)
        return found.select("seq", "timestamp", "rule_name", "result")


_rules("r01_all_rules", [HIGH, SUSTAINED, SPIKE, STABILITY, BOTH, DEVIATION, CHANGE, ABOVE, TOGETHER])
_rules("r02_threshold_rule", [HIGH])
_rules("r03_sustained_mean_rule", [SUSTAINED])
_rules("r04_spike_rule", [SPIKE])
_rules("r05_two_feature_rule", [BOTH])
_rules("r06_stability_rule", [STABILITY])
_rules("r07_deviation_rule", [DEVIATION])
_rules("r08_rate_sustained_multi_sensor", [CHANGE, ABOVE, TOGETHER])

EVENTS_SQL = f"""WITH {FRAME}, fired AS (
  {" UNION ALL ".join(
      f"SELECT seq, ts, '{r.name}' AS rule_name, '{r.result}' AS result, '{r.description}' AS rule_description FROM status WHERE {CONDITION[r.name]}"
      for r in DEMO
  )})
"""


def demo_events(spark: SparkSession, folder: str) -> DataFrame:
    found = ru.check(event_readings(spark, folder), DEMO)
    return found.select(
        "seq", "timestamp", "rule_name", "triggered", "result", F.to_json("sensor_values").alias("sensor_values"), "explanation",
        "rule_description",
    )


query(
    "r12_event_rows",
    EVENTS_SQL
    + """SELECT f.seq, f.ts AS timestamp, f.rule_name, true AS triggered, f.result,
      CASE WHEN e.event_id % 11 = 0 THEN '{}' ELSE '{"' || e.event_type || '":' || e.value || '}' END AS sensor_values,
      'Rule ''' || f.rule_name || ''' returned: ' || f.result AS explanation, f.rule_description
    FROM fired f JOIN events e ON e.event_id = f.seq""",
)(demo_events)


@query("r13_explanation", EVENTS_SQL + "SELECT seq, 'Rule ''' || rule_name || ''' returned: ' || result AS explanation FROM fired")
def explanations(spark: SparkSession, folder: str) -> DataFrame:
    return ru.check(event_readings(spark, folder), DEMO, snapshot=False).select("seq", "explanation")


@query(
    "r09_truthiness_guard",
    """SELECT event_id AS seq, 'low_' || event_type AS rule_name FROM events
    WHERE event_id % 11 <> 0 AND floor(value / 10) <> 0 AND floor(value / 10) < 2""",
)
def truthiness(spark: SparkSession, folder: str) -> DataFrame:
    """A reading of zero never fires, although it is below the threshold."""
    tens = event_readings(spark, folder).withColumn("value", F.floor(F.col("value") / 10).cast("double"))
    rules = [
        Rule(f"low_{s}", lambda st, s=s: truthy(st.get(s, "0")) & (st.get(s, "0") < 2), "low")
        for s in ("click", "error", "purchase", "signup", "view")
    ]
    return ru.check(tens, rules, align=False, snapshot=False).select("seq", "rule_name")


@query(
    "r10_rule_errors",
    f"WITH {FRAME} SELECT seq, 'view_and_error' AS rule_name FROM status WHERE (view_mean > 55 AND error_max > 150) IS NULL",
)
def rule_errors(spark: SparkSession, folder: str) -> DataFrame:
    _, reqs = TOGETHER.compile()
    status = ru.status_table(event_readings(spark, folder), reqs)
    return ru.rule_errors(status, [TOGETHER]).select("seq", "rule_name")


def _spread(status):
    now, mean = status.get("click", "0"), status.get("click", "10m:", "mean")
    if now and mean and now - mean > 80:
        return f"click {now:.2f} over mean"
    return None


def _fragile(status):
    return "ratio high" if status.get("click", "0") / status.get("view", "10m:", "mean") > 3 else None


SPREAD = RuleFunction("click_spread", _spread, (Requirement("click", "0"), Requirement("click", "10m:", "mean")), "Click far above its mean")
FRAGILE = RuleFunction("click_view_ratio", _fragile, (Requirement("click", "0"), Requirement("view", "10m:", "mean")))


@query(
    "r11_rule_functions",
    f"""WITH {FRAME} SELECT seq, 'click_spread' AS rule_name, printf('click %.2f over mean', click) AS result FROM status
    WHERE click <> 0 AND click_mean <> 0 AND click - click_mean > 80
    UNION ALL SELECT seq, 'click_view_ratio', 'ratio high' FROM status WHERE view_mean <> 0 AND click / view_mean > 3""",
)
def rule_functions(spark: SparkSession, folder: str) -> DataFrame:
    found = ru.check(event_readings(spark, folder), [SPREAD, FRAGILE], snapshot=False)
    return found.select("seq", "rule_name", "result")


def _zone(status):
    """Several ways to an event, with missing values and a computed feature."""
    now, mean, spread = status.get("click", "0"), status.get("click", "10m:", "mean"), status.get("click", "10m:", "std")
    if now is None or mean is None:
        return "no click" if status.get("view", "0") is None else None
    if spread and abs(now - mean) > 2 * spread:
        return "far above" if now > mean else "far below"
    return next((f"level {step}" for step in (120, 100) if now > step), None)


TRACED = [
    RuleFunction("high_click", lambda s: "high" if s.get("click", "0") and s.get("click", "0") > 120 else None, (Requirement("click", "0"),)),
    RuleFunction("sustained_view", lambda s: "sustained" if (s.get("view", "10m:", "mean") or 0) > 70 else None, (Requirement("view", "10m:", "mean"),)),
    RuleFunction("error_peak", lambda s: "peak" if (s.get("error", "10m:", "max") or 0) > 200 else None, (Requirement("error", "10m:", "max"),)),
    RuleFunction("click_zone", _zone, (Requirement("click", "0"), Requirement("click", "10m:", "mean"), Requirement("click", "10m:", "std"), Requirement("view", "0"))),
]


@query(
    "r11_traced_functions",
    f"""WITH {FRAME}, zone AS (SELECT seq, CASE
        WHEN click IS NULL OR click_mean IS NULL THEN CASE WHEN view IS NULL THEN 'no click' END
        WHEN click_std <> 0 AND abs(click - click_mean) > 2 * click_std THEN CASE WHEN click > click_mean THEN 'far above' ELSE 'far below' END
        WHEN click > 120 THEN 'level 120' WHEN click > 100 THEN 'level 100' END AS result FROM status)
    SELECT seq, 'high_click' AS rule_name, 'high' AS result FROM status WHERE click > 120
    UNION ALL SELECT seq, 'sustained_view', 'sustained' FROM status WHERE view_mean > 70
    UNION ALL SELECT seq, 'error_peak', 'peak' FROM status WHERE error_max > 200
    UNION ALL SELECT seq, 'click_zone', result FROM zone WHERE result IS NOT NULL""",
)
def traced_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Python rule functions that become expressions: no Python worker takes part."""
    return ru.check(event_readings(spark, folder), TRACED, snapshot=False).select("seq", "rule_name", "result")


@query("r10_function_errors", f"WITH {FRAME} SELECT seq, 'click_view_ratio' AS rule_name FROM status WHERE click IS NULL OR view_mean IS NULL")
def function_errors(spark: SparkSession, folder: str) -> DataFrame:
    status = ru.status_table(event_readings(spark, folder), list(FRAGILE.requirements))
    return ru.function_errors(status, [FRAGILE]).select("seq", "rule_name")


@query(
    "r14_run_statistics",
    EVENTS_SQL
    + """SELECT 3 AS num_rules, '1m' AS granularity, (SELECT count(DISTINCT event_type) FROM events) AS num_sensors_tracked,
    (SELECT count(*) FROM fired) AS total_events""",
)
def run_statistics(spark: SparkSession, folder: str) -> DataFrame:
    readings = event_readings(spark, folder)
    return ru.run_statistics(readings, ru.check(readings, DEMO, snapshot=False), len(DEMO))


@query("r15_events_per_rule", EVENTS_SQL + "SELECT rule_name, count(*) AS events FROM fired GROUP BY rule_name")
def events_per_rule(spark: SparkSession, folder: str) -> DataFrame:
    return ru.events_per_rule(ru.check(event_readings(spark, folder), DEMO, snapshot=False))


@query("r16_events_by_name", EVENTS_SQL + "SELECT seq, rule_name FROM fired WHERE contains(rule_name, 'click')")
def events_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return ru.named(ru.check(event_readings(spark, folder), DEMO, snapshot=False), "click").select("seq", "rule_name")


@query(
    "r17_reading_at_event",
    EVENTS_SQL
    + """SELECT f.seq, f.rule_name, CASE WHEN f.seq % 11 <> 0 THEN e.value END AS value
    FROM fired f JOIN events e ON e.event_id = f.seq AND e.event_type = 'click'""",
)
def reading_at_event(spark: SparkSession, folder: str) -> DataFrame:
    readings = event_readings(spark, folder)
    return ru.readings_at(ru.check(readings, DEMO, snapshot=False), readings, "click").select("seq", "rule_name", "value")


# Rule rows grow with the part table: two conditions each, on sensors and thresholds the part gives.
RULE_ROWS = """
SELECT p_partkey AS rule_id, 'rule_' || p_partkey AS rule_name,
  CASE p_size % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS sensor_id,
  '10m:' AS time_expression, 'mean' AS statistic, '>' AS op, 55.0D + p_partkey % 40 AS threshold, lower(p_type) AS result
FROM {part}
UNION ALL
SELECT p_partkey, 'rule_' || p_partkey,
  CASE p_size % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END,
  '0', NULL, CASE WHEN p_partkey % 2 = 0 THEN '>=' ELSE '<' END, 150.0D + p_size, lower(p_type)
FROM {part}
"""
ROW_RULES_SQL = f"""WITH rules AS ({plain(RULE_ROWS).replace("D +", " +")}),
readings AS (SELECT event_type AS sensor_id, ts, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events),
counted AS (SELECT *, count(value) OVER (PARTITION BY sensor_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM readings),
features AS (SELECT seq, sensor_id, value AS now, avg(value) OVER (PARTITION BY sensor_id ORDER BY n RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean FROM counted)
SELECT f.seq, a.rule_name, a.result FROM features f
JOIN rules a ON a.sensor_id = f.sensor_id AND a.statistic = 'mean' AND f.mean > a.threshold AND f.mean <> 0
JOIN rules b ON b.rule_id = a.rule_id AND b.statistic IS NULL AND f.now <> 0
  AND CASE WHEN b.op = '>=' THEN f.now >= b.threshold ELSE f.now < b.threshold END"""

# Rules on two sensors: a click now and the mean of views before it, for every part.
PAIR_ROWS = """
SELECT p_partkey AS rule_id, 'pair_' || p_partkey AS rule_name, 'click' AS sensor_id, '0' AS time_expression,
  NULL AS statistic, '>' AS op, 150.0D + p_partkey % 90 AS threshold, lower(p_type) AS result FROM {part}
UNION ALL
SELECT p_partkey, 'pair_' || p_partkey, 'view', '10m:', 'mean', '>', 50.0D + p_size, lower(p_type) FROM {part}
"""
PAIR_SQL = f"""WITH {FRAME} SELECT s.seq, 'pair_' || p_partkey AS rule_name, lower(p_type) AS result
FROM status s JOIN part ON s.click > 150 + p_partkey % 90 AND s.view_mean > 50 + p_size"""


@query("r19_rules_as_rows_two_sensors", PAIR_SQL)
def pair_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = derived(spark, folder, PAIR_ROWS, "part")
    return ru.check_rows(event_readings(spark, folder), rows, snapshot=False).select("seq", "rule_name", "result")


@query("r19_rules_as_rows", ROW_RULES_SQL)
def rules_as_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = derived(spark, folder, RULE_ROWS, "part")
    return ru.check_rows(event_readings(spark, folder), rows, align=False, snapshot=False).select("seq", "rule_name", "result")


# Rules whose text is catalogued and whose function is registered under their name.
FOUND = """SELECT seq, '{spread}' AS rule_name, printf('click %.2f over mean', click) AS result FROM status
    WHERE click <> 0 AND click_mean <> 0 AND click - click_mean > 80 AND '{spread}' IN (SELECT name FROM loaded)
    UNION ALL SELECT seq, '{ratio}', 'ratio high' FROM status WHERE view_mean <> 0 AND click / view_mean > 3 AND '{ratio}' IN (SELECT name FROM loaded)"""


def _registry(spread: str, ratio: str) -> dict[str, RuleFunction]:
    return {spread: replace(SPREAD, name=spread), ratio: replace(FRAGILE, name=ratio), "unused": replace(FRAGILE, name="unused")}


@query(
    "r19_registered_rules",
    f"""WITH rules AS ({plain(RULES)}), {FRAME}, loaded AS (SELECT rule_type AS name FROM rules WHERE collection_id = 3 AND verification_status = 'ok')
    {FOUND.format(spread="safety", ratio="operational")}""",
)
def registered_rules(spark: SparkSession, folder: str) -> DataFrame:
    """From the catalogue to events: the rules of a collection by their kind, each kind a registered function."""
    loaded = sr.load_rules(derived(spark, folder, RULES, "lineitem"), collection_id=3, parity=True)
    rules = ru.from_rule_table(loaded.select(F.col("rule_type").alias("rule_name")), _registry("safety", "operational"))
    return ru.check(event_readings(spark, folder), rules, snapshot=False).select("seq", "rule_name", "result")


@query(
    "s08_rules_from_list",
    f"WITH {FRAME}, loaded AS (SELECT lower(r_name) AS name FROM region) {FOUND.format(spread='europe', ratio='asia')}",
)
def rules_from_list(spark: SparkSession, folder: str) -> DataFrame:
    """Rules given as dicts in a program, here one per region, to the events of those that have a function."""
    given = [{"rule_name": row["name"], "rule_body": "def f(status): return None"} for row in table(spark, folder, "region").select(F.lower("r_name").alias("name")).collect()]  # five regions
    rules = ru.from_rule_table(sr.from_dicts(spark, given), _registry("europe", "asia"))
    return ru.check(event_readings(spark, folder), rules, snapshot=False).select("seq", "rule_name", "result")
