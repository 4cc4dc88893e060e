import itertools
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gaugeflow.model import Requirement, RuleFunction
from gaugeflow.operators import rules as ru
from gaugeflow.operators import ruletrace
from gaugeflow.plans import rule_queries

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

A, B = Requirement("a", "0"), Requirement("b", "5m:", "mean")
LIMIT, STEPS, SEEN = 2, (1, 2.5), []


def helper(value, least=LIMIT):
    return value is not None and value >= least


def _a(status):
    return status.get("a", "0")


def _b(status):
    return status.get("b", "5m:", "mean")


def nested(status):
    a, b = _a(status), _b(status)
    if a is None:
        return "both gone" if b is None else None
    for step in STEPS:
        if a > step and not (b is not None and b < step):
            return f"over {step}"
    return False if a == 0 else None


PLAIN = {
    "nested": nested,
    "guard": lambda s: "yes" if _a(s) and _a(s) > 1 else None,
    "fails on none": lambda s: "x" if _a(s) > _b(s) else None,
    "reflected": lambda s: "x" if 1 < _a(s) else None,
    "arithmetic": lambda s: "x" if (_a(s) or 0) * 2 - (_b(s) or 1) / 2 + 1 > 0.5 else None,
    "ratio": lambda s: "x" if _a(s) / _b(s) > 0.5 else 1,
    "by zero": lambda s: _a(s) / 0 and None,
    "not a number": lambda s: "x" if _a(s) - _a(s) != 0 else None,
    "nan is above nothing": lambda s: "x" if (_a(s) - _a(s)) * 1 > -5 else None,
    "helper": lambda s: "x" if helper(_a(s)) and helper(_b(s), least=1) else None,
    "builtins": lambda s: "x" if any(v is not None and abs(v) > 1 for v in (_a(s), _b(s))) else None,
    "largest": lambda s: "x" if max(_a(s), _b(s)) == _a(s) else None,
    "kind": lambda s: 1 if isinstance(_a(s), float) else 2.5,
    "raises": lambda s: [][0] if _a(s) == 2 else None,
    "comparison itself": lambda s: _a(s) == _b(s),
    "text": lambda s: _a(s) == "x" or None,
    "negative": lambda s: "x" if _a(s) is not None and -_a(s) > 0 else None,
    "undeclared": lambda s: s.get("c", "0"),
    "chained": lambda s: "x" if 0 < (_a(s) or 0) <= 2 else None,
}
PYTHON = {
    "value in the text": lambda s: f"{_a(s)}",
    "value itself": lambda s: _a(s),
    "rounded": lambda s: round(_a(s) or 0) or None,
    "remainder": lambda s: "x" if (_a(s) or 0) % 2 == 1 else None,
    "state": lambda s: SEEN.append(1),
    "handles errors": lambda s: caught(s),
    "too many ways": lambda s: sum_of_bits(s),
    "callable object": ru.truthy.__call__,
}


def caught(status):
    try:
        return "x" if _a(status) > 1 else None
    except TypeError:
        return "gone"


def sum_of_bits(status):
    n = 0
    for step in range(60):
        n = n + 1 if (_a(status) or 0) > step else n - 1
    return "x" if n > 0 else None


@pytest.fixture(scope="module")
def moments(spark):
    values = [None, 0.0, -0.0, 1.0, 2.0, 3.5, -1.5, float("inf"), float("-inf"), float("nan"), 1e308]
    rows = [(i, a, b) for i, (a, b) in enumerate(itertools.product(values, values))]
    frame = spark.createDataFrame(rows, f"seq bigint, `{A.name}` double, `{B.name}` double")
    return frame.select(F.lit("").alias("asset"), F.timestamp_seconds("seq").alias("ts"), F.col("seq").alias("ts_us"), "seq", f"`{A.name}`", f"`{B.name}`")


def said(frame):
    return sorted(((r.seq, r.rule_name, r.result, r.error) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_expression_says_what_the_function_says(moments, name):
    assert ruletrace.traced(PLAIN[name], [A.name, B.name]) is not None
    rules = [RuleFunction(name, PLAIN[name], (A, B))]
    assert said(ru._called(moments, rules, None)) == said(ru._run(moments, rules, [A.name, B.name]))


@pytest.mark.parametrize("name", sorted(PYTHON))
def test_others_stay_python(spark, name):
    assert ruletrace.traced(PYTHON[name], [A.name, B.name]) is None and not SEEN


def test_both_kinds_together(moments):
    rules = [RuleFunction(name, fn, (A, B)) for name, fn in (PLAIN | {"caught": caught, "rounded": PYTHON["rounded"]}).items()]
    assert said(ru._called(moments, rules, None)) == said(ru._run(moments, rules, [A.name, B.name]))


def test_no_python_worker(spark, data):
    plan = rule_queries.traced_functions(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan
