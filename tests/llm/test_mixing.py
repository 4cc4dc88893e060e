from collections import defaultdict

import pytest
from compare import database, difference
from gaugeflow.llm import mixing, queries
from llm_rows import frame
from pyspark.sql import functions as F


def test_statement(spark, data):
    assert difference(spark, database(data), queries.QUERIES["op6_mixing"], queries.SQL["op6_mixing"], data) is None


def test_plan_is_native(spark, data):
    plan = queries.QUERIES["op6_mixing"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_odd_rows(odd):
    rows = mixing.mix(odd, carry=("doc_id", "source")).collect()
    assert len(rows) == odd.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r.repeats <= 3
        sizes[r.row.source] += r.size
        taken[r.row.source] += r.size * r.repeats
    targets = {r.row.source: r.target for r in rows}
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    longest = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.row.source] and r.target <= 3 * r.source_size
        longest[r.row.source] = max(longest[r.row.source], r.size)
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1 for s in sizes)
    again = mixing.mix(odd.repartition(5), carry=("doc_id", "source")).collect()
    key = lambda r: (str(r.row), r.size, r.repeats)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_excess_goes_to_the_others(spark):
    docs = frame(spark, [(0, "w " * 10, "en", "a"), (1, "w " * 500, "en", "b"), (2, "w " * 490, "en", None)])
    told = {r.row.source: r.target for r in mixing.mix(docs, carry=("source",)).collect()}
    assert told["a"] == 30 and abs(told["b"] - 970 * 2 / 3) < 1e-9 and abs(told[None] - 970 / 3) < 1e-9


@pytest.mark.parametrize("key", [None, 7])
def test_one_key_is_spread_by_its_texts(spark, key):
    docs = frame(spark, [(key, f"w{i} " * (1 + i % 7), "en", "a" if i % 3 else "b") for i in range(3000)])
    rows = mixing.mix(docs, carry=("doc_id", "source")).collect()
    targets, taken = {r.row.source: r.target for r in rows}, defaultdict(int)
    for r in rows:
        taken[r.row.source] += r.size * r.repeats
    assert len(rows) == 3000 and all(abs(taken[s] - targets[s]) <= 4 for s in targets)
    order = docs.select(F.substring(mixing.order_of(docs["doc_id"], docs["text"], mixing.SEED), 1, 3).alias("slice"))
    assert order.groupBy("slice").count().agg(F.max("count")).first()[0] < 12


def test_repeated_keeps_the_columns(odd, nothing):
    assert mixing.repeated(odd).columns == odd.columns
    assert mixing.repeated(nothing).count() == 0 and mixing.mix(nothing).count() == 0
