"""The rule index against testing every rule on every row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.model import CheckerConfig
from gaugeflow.operators import ruleindex
from gaugeflow.operators import rules as ru
from gaugeflow.sources import readings as rd

TESTS = {
    ">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<": lambda v, t: v < t, "<=": lambda v, t: v <= t,
    "==": lambda v, t: v == t, "!=": lambda v, t: v != t,
}
NUMBERS = list(ruleindex.OPS)


@pytest.mark.parametrize("seed, block", [(1, 4), (2, 64), (3, 512)])
def test_every_comparison(seed, block):
    rng = random.Random(seed)
    conditions = []
    for rule in range(300):
        for _ in range(rng.randint(1, 4)):
            conditions.append((rule * 3, rng.randint(0, 2), rng.randint(0, 6), rng.choice([-math.inf, math.inf, *map(float, range(-3, 8))])))
    index = ruleindex.RuleIndex(*(np.array(c) for c in zip(*conditions)), block=block)
    values = {f: np.array([rng.choice([math.nan, 2.5, -math.inf, *map(float, range(-4, 9))]) for _ in range(60)]) for f in range(3)}
    got = sorted((int(r), int(n)) for row, rule in index.match(values, 60) for r, n in zip(row, rule))
    holds = lambda r, f, op, t: op and TESTS[NUMBERS[op - 1]](values[f][r], t) and not math.isnan(values[f][r])
    own = {}
    for rule, *c in conditions:
        own.setdefault(rule, []).append(c)
    assert got == sorted((r, rule) for r in range(60) for rule, cs in own.items() if all(holds(r, *c) for c in cs))
    assert got


def test_nan_thresholds_are_above_every_value():
    rule, op = np.arange(6), np.arange(1, 7)
    index = ruleindex.RuleIndex(rule, np.zeros(6, int), op, np.full(6, np.nan))
    found = [(row.tolist(), rules.tolist()) for row, rules in index.match({0: np.array([5.0, np.nan])}, 2)]
    assert found == [([0, 0, 0], [2, 3, 5])]  # <, <=, !=


def test_no_rules_and_no_rows():
    none = ruleindex.RuleIndex(*(np.zeros(0, k) for k in (int, int, int, float)))
    assert list(none.match({}, 0)) == []
    one = ruleindex.RuleIndex(np.array([7]), np.array([0]), np.array([1]), np.array([1.0]))
    assert list(one.match({0: np.zeros(0)}, 0)) == []


ROWS = "rule_id bigint, rule_name string, sensor_id string, time_expression string, statistic string, op string, threshold double, result string"


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(4)
    data = [(s, m * 60, m, rng.choice([None, 0.0, float("nan"), *map(float, range(1, 9))])) for m in range(80) for s in "abc"]
    return rd.from_long(spark.createDataFrame(data, "sensor_id string, at long, n long, value double").withColumn("ts", F.timestamp_seconds("at")), seq="n").cache()


def rule_rows(count=120, mixed=True):
    rng = random.Random(5)
    out = []
    for rule in range(count):
        sensors = rng.choice(["a", "b", "c", "nowhere"]) if not mixed or rng.random() < 0.6 else None
        for _ in range(rng.randint(1, 3)):
            expression, statistic = rng.choice([("0", None), ("5m:", "mean"), ("3m", None), ("4m:1m", "max")])
            out.append((rule, f"r{rule}", sensors or rng.choice("abc"), expression, statistic, rng.choice([*NUMBERS, "~"]) if rng.random() < 0.1 else rng.choice(NUMBERS), float(rng.randint(0, 8)), f"x{rule % 7}"))
    return out


def one_by_one(readings, rows, align, guard="nonzero"):
    rules = []
    for rule in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == rule]

        def when(s, own=own):
            test = F.lit(True)
            for _, _, sensor, expression, statistic, op, threshold, _ in own:
                value = s.get(sensor, expression, statistic)
                test = test & ru.truthy(value, guard) & (TESTS[op](value, threshold) if op in TESTS else F.lit(False))
            return test

        rules.append(ru.Rule(own[0][1], when, own[0][7]))
    return ru.check(readings, rules, align=align, snapshot=False)


def told(df):
    return sorted((r.seq, r.rule_name, r.result) for r in df.select("seq", "rule_name", "result").collect())


@pytest.mark.parametrize("guard", ["nonzero", "not_null"])
@pytest.mark.parametrize("at_once", [500_000, 40])
def test_rows_equal_rules_one_by_one(spark, readings, monkeypatch, guard, at_once):
    monkeypatch.setattr(ruleindex, "CONDITIONS_AT_ONCE", at_once)
    rows = rule_rows()
    got = told(ru.check_rows(readings, spark.createDataFrame(rows, ROWS), guard=guard, snapshot=False))
    # a rule on one sensor is decided on that sensor's rows, of which every moment has one here
    assert got and got == told(one_by_one(readings, rows, True, guard))


def test_incomplete_conditions_never_hold(spark, readings):
    whole = (1, "whole", "a", "0", None, ">", 2.0, "x")
    broken = [(2, "b", None, "0", None, ">", 2.0, "x"), (3, "c", "a", None, None, ">", 2.0, "x"), (4, "d", "a", "0", None, None, 2.0, "x"), (5, "e", "a", "0", None, ">", None, "x"), (6, "f", "a", "odd", None, ">", 2.0, "x")]
    rows = [whole, *broken, *[(r[0], r[1], *whole[2:]) for r in broken]]
    got = told(ru.check_rows(readings, spark.createDataFrame(rows, ROWS), snapshot=False))
    assert {name for _, name, _ in got} == {"whole"}


def test_rules_without_an_id_are_one_rule(spark, readings):
    rows = [(None, "n", "a", "0", None, ">", 2.0, "x"), (None, "n", "a", "0", None, "<", 6.0, "x"), (1, "o", "a", "0", None, ">", 7.0, "y")]
    got = told(ru.check_rows(readings, spark.createDataFrame(rows, ROWS), snapshot=False))
    assert got == told(one_by_one(readings, [(r[0] or 0, *r[1:]) for r in rows], True))


def test_only_firing_pairs_are_rows(spark, readings):
    rows = spark.createDataFrame(rule_rows(mixed=False), ROWS)
    found = ru.check_rows(readings, rows, snapshot=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
    assert ru.check_rows(readings, rows.limit(0)).count() == 0
    assert ru.check_rows(readings, rows, CheckerConfig(mode="time"), snapshot=False).count() > 0


def test_what_fires_meets_no_other_table(spark, readings):
    # far more events than rows and rules: joined to the rules' names they were taken for the small side and sent to the driver
    rows = spark.createDataFrame(rule_rows(mixed=False), ROWS)
    plan = ru.check_rows(readings, rows, snapshot=False)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]


def test_batches_of_what_fires_are_bounded(spark, readings, monkeypatch):
    rows = spark.createDataFrame(rule_rows(), ROWS)
    whole = told(ru.check_rows(readings, rows, snapshot=False))
    monkeypatch.setattr(ruleindex, "FIRED_AT_ONCE", 3)
    assert whole and told(ru.check_rows(readings, rows, snapshot=False)) == whole


@pytest.mark.parametrize("pairs", [ruleindex.PAIRS_AT_ONCE, 100])
def test_lists_stand_for_the_pairs_that_fire(monkeypatch, pairs):
    # rows that fire the same rules told them again and again: a task wrote as many names and results as there are events
    monkeypatch.setattr(ruleindex, "PAIRS_AT_ONCE", pairs)
    rng = np.random.default_rng(6)
    rule = np.repeat(np.arange(1_500), 2)
    feature = np.tile([0, 1], 1_500)
    index = ruleindex.RuleIndex(rule, feature, rng.integers(1, 7, len(rule)), rng.normal(size=len(rule)).round(2))
    values = {f: np.where(rng.random(2_000) < 0.1, np.nan, rng.normal(size=2_000).round(2)) for f in range(2)}
    want = [(r, n) for row, found in index.match(values, 2_000) for r, n in zip(row.tolist(), found.tolist())]
    got, entries = [], 0
    for x in index.together(values):
        entries += len(x.row) + len(x.rule)
        for a, b, c, d in zip([0, *x.row_ends[:-1]], x.row_ends, [0, *x.rule_ends[:-1]], x.rule_ends):
            assert 0 < (b - a) * (d - c) <= pairs
            got += [(r, n) for r in x.row[a:b].tolist() for n in x.rule[c:d].tolist()]
    assert len(got) == len(set(got)) and sorted(got) == sorted(want)
    assert entries < len(got) / (4 if pairs > 1_000 else 2)


def test_blocks_that_no_row_reaches_are_passed_over(monkeypatch):
    # every row looked for its cell in every block, though most thresholds are far from it
    looked = []
    whole = np.searchsorted
    monkeypatch.setattr(ruleindex.np, "searchsorted", lambda a, v, *side: (looked.append(np.size(v)), whole(a, v, *side))[1])
    rule = np.repeat(np.arange(20_480), 2)
    index = ruleindex.RuleIndex(rule, np.tile([0, 1], 20_480), np.full(len(rule), 1), np.arange(len(rule)).astype(float))
    looked.clear()
    rows = 50_000
    assert list(index.together({0: np.full(rows, 600.0), 1: np.full(rows, 1e6)}))
    assert sum(looked) < 4 * rows
