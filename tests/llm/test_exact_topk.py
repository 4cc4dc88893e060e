import numpy as np
import pytest
from compare import database, difference
from pyspark.sql import functions as F

from gaugeflow.llm import exact_topk, queries


def test_statement(spark, data):
    assert difference(spark, database(data), queries.QUERIES["op8_exact_topk"], queries.SQL["op8_exact_topk"], data) is None


def plain(rows, asked, k):
    out = []
    for q, v in sorted({i: v for i, v in asked}.items()):
        scored = sorted((-int(np.dot(v, w)), float("inf") if i is None else i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, None if i == float("inf") else i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_against_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, rng.integers(-20, 20, 6).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(2000, [1, 2, 3]), (2001, [3, 2, 1]), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    told = exact_topk.top_k(df, df.where("id % 50 = 0"), k=10, vector_block=block, query_block=block).collect()
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in told), key=key) == plain(rows, asked, 10)


def test_bounds_hold_and_spare_reads():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-500, 500, (2000, 16))
    file = exact_topk.ApproximationFile(np.arange(2000), vectors)
    at = np.arange(16)[None, :]
    assert (file.low[at, file.cell] <= vectors).all() and (vectors <= file.high[at, file.cell]).all()


def test_unusable_vectors_and_empty_tables(spark):
    rows = [(0, [0.5, -0.25]), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (5, [0.25, 0.0]), (100, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select(F.col("vec_id").alias("id"), exact_topk.scaled(F.col("embedding"), 1024).alias("vector"))
    told = exact_topk.top_k(df, df.where("id % 100 = 0")).collect()
    assert sorted(tuple(r) for r in told) == [(0, 1, 5, 512 * 256), (0, 2, 100, -512 * 1024 - 256 * 1024), (100, 1, 5, -1024 * 256), (100, 2, 0, -512 * 1024 - 256 * 1024)]
    assert exact_topk.top_k(df.limit(0), df).count() == 0 and exact_topk.top_k(df, df.limit(0)).count() == 0
