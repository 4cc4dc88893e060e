import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeflow.operators import layout


@pytest.mark.parametrize("mode", ["plain", "split", "auto"])
def test_running_count_with_a_hot_key(spark, mode):
    """One key holds a third of the rows; another has ties that only the second order column breaks."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("key"),
        (F.col("id") % 7).alias("ts"),
        "id",
        F.when(F.col("id") % 4 > 0, F.col("id")).alias("value"),
    )
    got = layout.running_count(df, ["key"], ["ts", "id"], F.col("value"), layout=mode, max_rows=400)
    want = df.withColumn("n", F.count("value").over(W.partitionBy("key").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_ranges_are_even_although_keys_are_not(spark):
    df = spark.range(20_000).select(F.lit("only").alias("key"), F.lit(0).alias("ts"), F.col("id").alias("seq"))
    sizes = [r["count"] for r in layout.ranges(df, ["key"], ["ts", "seq"], 20_000, 2_000).groupBy("_range").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 5_000


def test_division(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)], "key string")
    assert layout.divide(df, ["key"], "auto", 10).hot is None
    split = layout.divide(df, ["key"], "auto", 5)
    assert (split.fits.count(), split.hot.count(), split.hot_rows) == (1, 10, 10)
