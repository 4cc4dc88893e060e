"""Samples are of rows, whatever the keys and however many the labels."""

from pyspark.sql import functions as F

from gaugeflow.llm import language, quality_model
from gaugeflow.llm.sampling import per_class


def test_rows_that_are_all_alike_are_drawn(spark):
    rows = spark.range(60_000).select(F.lit("en").alias("label"), F.lit(243).alias("key"), F.lit("same text").alias("text")).repartition(4)
    for each in (50, 500):
        assert 0.7 * each < per_class(rows, "label", each).count() < 1.3 * each


def test_no_label_is_left_out(spark):
    rows = spark.range(60_000).select(F.concat(F.lit("l"), F.pmod("id", F.lit(2000))).alias("label"), "id")
    drawn = per_class(rows, "label", 500, most=10_000)
    assert drawn.select("label").distinct().count() == 2000
    assert drawn.count() <= 60_000
    many = spark.range(100_000).select(F.concat(F.lit("l"), F.pmod("id", F.lit(100))).alias("label"), "id")
    assert 5_000 < per_class(many, "label", 500, most=10_000).count() < 15_000
    assert per_class(rows.limit(0), "label", 5).count() == 0
    assert per_class(rows.select(F.lit(None).cast("string").alias("label")), "label", 5).count() == 0


def test_language_with_one_key_for_all_rows(spark):
    rows = [(7, "the house and the garden are here " * 3, "en"), (7, "das haus und der garten sind hier " * 3, "de"), (None, "the cat sat on the mat", "en")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit(docs, F.col("text"), F.col("lang"), each=100)
    told = language.identify(docs, model).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in told} == {"en": 800, "de": 400}


def test_quality_with_a_key_of_many_rows(spark, monkeypatch):
    docs = spark.range(20_000).select(F.pmod("id", F.lit(10)).alias("doc_id"), F.concat(F.lit("some plain words "), F.col("id")).alias("text"))
    labels = spark.range(10).select(F.col("id").alias("doc_id"), F.pmod("id", F.lit(2)).cast("int").alias("quality"))
    seen = []
    real = quality_model.train
    monkeypatch.setattr(quality_model, "train", lambda x, row, y, **more: (seen.append(len(y)), real(x, row, y, **more))[1])
    quality_model.fit(docs, labels, each=200, steps=5)
    assert 250 < seen[0] < 600
