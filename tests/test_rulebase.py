import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import rulecalls
from gaugeflow.operators import consolidation as co
from gaugeflow.operators import rulebase as rb

BODIES = {
    "ok": 'def r(status):\n    return status.get("a", "10m:", "mean")',
    "no_calls": "def r(status):\n    return None",
    "syntax_error": "def r(status) return",
    "invalid_sensor": 'def r(status):\n    return status.get("ghost", "0")',
    "invalid_time": 'def r(status):\n    return status.get("a", "soon")',
    "no_statistic": 'def r(status):\n    return status.get("a", "5m:")',
    "unknown_statistic": 'def r(status):\n    return status.get("a", "5m:", "median")',
    "point_statistic": 'def r(status):\n    return status.get("a", "5m", "mean")',
    "first_fault": 'def r(status):\n    return status.get("a", "soon") or status.get("ghost", "0")',
    "not_constant": "def r(status):\n    return status.get(name, '0')",
    "in_comment": 'def r(status):\n    # status.get("ghost", "0")\n    return status.get("a", "0")',
}
WANT = {
    "ok": "ok", "no_calls": "ok", "syntax_error": "syntax_error", "invalid_sensor": "invalid_sensor", "invalid_time": "invalid_time",
    "no_statistic": "invalid_statistic", "unknown_statistic": "invalid_statistic", "point_statistic": "invalid_statistic",
    "first_fault": "invalid_time", "not_constant": "invalid_sensor", "in_comment": "ok",
}


@pytest.fixture(scope="module")
def sensors(spark):
    return spark.createDataFrame([("a",), ("b",)], "sensor_id string")


def test_verify(spark, sensors):
    rules = spark.createDataFrame(list(BODIES.items()), "rule_id string, rule_body string")
    assert {r.rule_id: r.verification_status for r in rb.verify(rules, sensors).collect()} == WANT


def test_wider_statistics(spark, sensors):
    rules = spark.createDataFrame([("x", BODIES["unknown_statistic"])], "rule_id string, rule_body string")
    assert rb.verify(rules, sensors, ("mean", "median")).first().verification_status == "ok"


def test_nested_calls_in_tree_order(spark):
    body = 'x = status.get("a", "0") - max(status.get("b", "5m:", stat), status.get("c"))'
    got = spark.createDataFrame([(body,)], "b string").select(rulecalls.analyse("b").alias("r")).first().r
    assert got.syntax_ok and [tuple(c) for c in got.calls] == [("a", "0", None), ("b", "5m:", None), ("c", None, None)]


def test_answers(spark):
    rule = '{"rule_name": "%s", "rule_description": "d", "rule_reasoning": "r", "rule_source": "s", "rule_body": "%s"}'
    good = rule % ("good_rule", "def f(status): status.get(1)")
    texts = [
        '{"rules": [%s]}' % good,
        'text\n```json\n{"rules": [%s, %s]}\n```\nmore' % (good, rule % ("HighTemp", "pass")),
        '{"rules": [{"rule_name": ',
        '{"rules": []}',
        "",
    ]
    answers = spark.createDataFrame(list(enumerate(texts)), "task_id bigint, answer string")
    parsed = rb.parse_answers(answers)
    got = sorted((r.task_id, r.rule_idx, r.rule_name, r.error) for r in parsed.collect() if r.error is None)
    assert got == [(0, 0, "good_rule", None), (1, 0, "good_rule", None), (1, 1, "HighTemp", None)]
    assert sorted(r.task_id for r in parsed.where("error = 'json'").collect()) == [2, 4]
    valid, rejected = rb.check_schema(parsed.where("error is null"))
    assert valid.count() == 2 and len(rejected.first().errors) == 3
    assert [r.task_id for r in rb.check_schema(parsed.where("error is null"), per=("task_id",))[0].collect()] == [0]


def test_answers_are_checked_whole(spark):
    good = '{"rule_name": "good", "rule_description": "d", "rule_reasoning": "r", "rule_source": "s", "rule_body": "def f(status): status.get(1)"%s}'
    texts = {
        "null": '{"rules": null}',
        "object": '{"rules": {"a": 1}}',
        "list": "[]",
        "absent": "{}",
        "tail": '{"rules": [%s]} and so on' % (good % ""),
        "second": '{"rules": [%s]}, {"rules": []}' % (good % ""),
        "bare": '{"rules": [7]}',
        "number": '{"rules": [%s]}' % (good % ', "rule_type": 7'),
        "null_type": '{"rules": [%s]}' % (good % ', "rule_type": null'),
        "missing": '{"rules": [{"rule_name": "x", "rule_body": "def f(status): status.get(1)"}, %s]}' % (good % ""),
        "body": '{"rules": [{"rule_name": "x", "rule_description": "d", "rule_reasoning": "r", "rule_source": "s", "rule_body": {"a": 1}}]}',
    }
    answers = spark.createDataFrame(list(texts.items()), "task_id string, answer string")
    parsed = rb.parse_answers(answers)
    errors = {(r.task_id, r.rule_idx): r.error for r in parsed.collect()}
    assert errors == {
        ("null", None): "rules", ("object", None): "rules", ("list", None): "rules", ("tail", None): "json", ("second", None): "json",
        ("bare", 0): "types", ("number", 0): "types", ("null_type", 0): None, ("missing", 0): None, ("missing", 1): None, ("body", 0): "types",
    }
    valid, rejected = rb.check_schema(parsed)
    assert sorted((r.task_id, r.rule_idx) for r in valid.collect()) == [("missing", 1), ("null_type", 0)]
    assert {r.task_id: r.errors for r in rejected.collect()}["missing"] == [f"{f} is required" for f in ("rule_description", "rule_reasoning", "rule_source")]
    valid, rejected = rb.check_schema(parsed, per=("task_id",))
    assert [r.task_id for r in valid.collect()] == ["null_type"] and rejected.count() == parsed.count() - 1


def test_overlapping_descriptions_in_call_order(spark):
    rules = spark.createDataFrame(
        [(1, "status.get(\"temp top\", \"now\") + status.get('temp', \"now\")"), (2, 'status.get("temp", "now")'), (3, "pass")],
        "rule_id bigint, rule_body string",
    )
    mappings = spark.createDataFrame([(1, "temp", "T1"), (1, "temp top", "T2"), (2, "temp", None)], "rule_id bigint, sensor_description string, sensor_id string")
    got = {r.rule_id: r for r in rb.resolve_sensors(rules, mappings).collect()}
    assert got[1].rule_body == "status.get(\"T2\", \"now\") + status.get('T1', \"now\")" and got[1].sensor_parsing_status == "ok"
    assert got[2].rule_body == got[2].rule_body_original and got[2].sensor_parsing_status == "sensors_not_found"
    assert got[3].sensor_parsing_status == "no_sensors"


def test_times(spark):
    rules = spark.createDataFrame(
        [(1, 'status.get("a", "now") + status.get("a", "last hour")'), (2, 'status.get("a", "window")'), (3, 'status.get("a")'), (4, "pass")],
        "rule_id bigint, rule_body string",
    )
    mappings = spark.createDataFrame(
        [("now", "0", None), ("last hour", "1h:", "mean"), ("window", "5m:", None)], "time_description string, time_expression string, time_statistic string"
    )
    got = {r.rule_id: (r.rule_body, r.time_parsing_status) for r in rb.resolve_times(rules, mappings).collect()}
    assert got[1] == ('status.get("a", "0") + status.get("a", "1h:", "mean")', "ok")
    assert got[2] == ('status.get("a", "window")', "parse_error") and got[3][1] == "parse_error" and got[4] == ("pass", "ok")


@pytest.mark.parametrize("layout", ["plain", "split"])
def test_batches(spark, layout):
    sets = ["a"] * 70 + ["a,b"] * 30 + ["b"] * 20 + [""] * 5
    rules = spark.createDataFrame(
        [(i, " + ".join(f'status.get("{s}", "0")' for s in reversed(names.split(",")) if s)) for i, names in enumerate(sets)],
        "rule_id bigint, rule_body string",
    )
    batched = co.batches(rules, group_layout=layout)
    sizes = {(r.batch_key, r.batch_no): r["count"] for r in batched.groupBy("batch_key", "batch_no").count().collect()}
    assert sizes == {("a", 0): 50, ("a", 1): 20, ("a,b", 0): 30, ("b", 0): 20, ("__no_sensors__", 0): 5}
    assert tuple(co.batch_summary(batched).first()) == (125, 5, 25)
    assert co.batches(rules, whole_up_to=125).select("batch_key", "batch_no").distinct().count() == 1
    assert co.batches(rules, whole_up_to=124).select("batch_key", "batch_no").distinct().count() == 5


def test_calls_by_syntax_tree(spark):
    texts = [
        'x = 1  # status.get("comment", "0")\ny = "status.get(\'text\', \'0\')"',
        'status.get("a, b", "1h:5m", "mean") + status.get(("n"), "0")',
        'max(status.get("inner", "0"), f(status.get("deep", "5m")))',
        'status.get("broken", "0"',
        "x = " + "-" * 20_000 + "1",
        "x = a" + ".b" * 20_000,
        "(" * 20_000 + ")" * 20_000,
        None,
    ]
    rules = spark.createDataFrame(list(enumerate(texts)), "rule_id bigint, rule_body string")
    sets = {r.rule_id: r.s for r in rules.select("rule_id", rulecalls.sensor_set(F.col("rule_body")).alias("s")).collect()}
    assert sets == {0: [], 1: ["a, b", "n"], 2: ["deep", "inner"], 3: [], 4: [], 5: [], 6: [], 7: []}
    needed = {tuple(r) for r in rulecalls.requirements(rules).collect()}
    assert needed == {("a, b", "1h:5m", "mean"), ("n", "0", None), ("inner", "0", None), ("deep", "5m", None)}
    assert {r.batch_key for r in co.batches(rules).collect()} == {"__no_sensors__", "a, b,n", "deep,inner"}


def test_consolidation(spark, sensors):
    rules = spark.createDataFrame(
        [(i, i * 10, 1, i * 100, i * 1000, f"p{i}", "extracted") for i in range(1, 9)],
        "rule_id bigint, task_id bigint, collection_id bigint, document_id bigint, chunk_id bigint, source_chunk_preview string, lifecycle_status string",
    )
    out = "struct<rule_name: string, rule_description: string, rule_reasoning: string, rule_source: string, rule_body: string, rule_type: string>"
    good, bad = ("m", "d", "r", "s", BODIES["ok"], None), ("m", "d", "r", "s", BODIES["invalid_sensor"], None)
    actions = spark.createDataFrame(
        [
            (1, "remove", [1], None, 0.9, "no longer needed"),
            (2, "merge", [3, 2], good, 0.9, "say the same thing"),
            (3, "merge", [4, 5], bad, 0.9, "say the same thing"),
            (4, "simplify", [6], good, 0.6, "could be shorter"),
            (5, "merge", [7], good, 1.2, "say the same thing"),
            (6, "merge", [], good, 0.9, "say the same thing"),
            (7, "merge", [7], good, 0.9, "short"),
        ],
        f"action_id bigint, action_type string, input_rule_ids array<bigint>, output_rule {out}, confidence double, reasoning string",
    )
    valid, rejected = co.check_actions(actions)
    assert {r.action_id: r.errors for r in rejected.collect()} == {5: ["confidence"], 6: ["input_rule_ids"], 7: ["reasoning"]}
    kept = co.confident(valid)
    verified = co.verify_outputs(kept, sensors)
    assert {r.action_id: (r.passed, r.reason) for r in verified.collect()} == {2: (True, None), 3: (False, "Validation failed")}
    gone = co.superseded_ids(kept, verified)
    assert sorted(r.rule_id for r in gone.collect()) == [1, 2, 3]
    assert sorted(r.rule_id for r in co.superseded_ids(kept, verified, parity=True).collect()) == [2, 3, 4, 5]
    assert tuple(co.summarize(rules, kept, verified, gone).first()) == (8, 1, 3, 1, 2, 0, 1)
    marked, created = co.apply_actions(rules, verified, gone, 77)
    assert sorted(r.rule_id for r in marked.where("lifecycle_status = 'superseded'").collect()) == [1, 2, 3]
    new = created.first()
    assert (new.task_id, new.document_id, new.source_chunk_preview, new.consolidated_from_ids) == (20, 200, "p2", [3, 2])
    jobs = spark.createDataFrame([(77,), (78,)], "job_id bigint")
    assert [r.job_id for r in co.not_yet_applied(jobs, created).collect()] == [78]
    assert [r.job_id for r in co.already_applied(jobs, created).collect()] == [77]


def test_texts_are_parsed_once_and_by_all_cores(spark, data):
    from gaugeflow.plans import all_queries

    plan = all_queries()["t08_rule_calls_by_syntax"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1 and "RoundRobin" in plan[plan.index("EvalPython") :]


def test_answers_are_read_once(spark, data):
    from gaugeflow.plans import all_queries

    plan = all_queries()["v02_schema_checks"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "RoundRobin" in plan
