import numpy as np
from pyspark.sql import functions as F

from gaugeflow.llm import language, queries
from llm_rows import frame


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    told = queries.QUERIES["op1_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(told) > 200 and sum(r.lang == r.lang_pred for r in told) >= 0.97 * len(told)
    assert all(0 <= r.score <= 1 for r in told)


def model_of(odd):
    return language.fit(odd, F.col("text"), F.col("lang"), F.col("doc_id"), bits=10)


def test_odd_rows(odd):
    told = language.identify(odd, model_of(odd), key="doc_id").collect()
    assert len(told) == odd.count()
    by_id = {}
    for r in told:
        by_id.setdefault(r.doc_id, []).append(r)
    for k in (300, 301, 302):
        assert [(r.lang_pred, r.score) for r in by_id[k]] == [("und", 0.0)]
    assert by_id[304][0].lang_pred == "ja" and by_id[303][0].lang_pred != "und"
    assert len({(r.lang_pred, r.score) for r in by_id[310]}) <= 2


def test_families_first(spark):
    rows = [(i, t, lang, None) for i, (t, lang) in enumerate([("the house and the tree", "en"), ("das haus und der baum", "de"), ("la maison et le jardin", "fr"), ("la casa y el jardin", "es"), ("zzqq xx", "qq")] * 12)]
    docs = frame(spark, rows)
    model = language.fit(docs, F.col("text"), F.col("lang"), F.col("doc_id"), bits=10)
    assert model.families == {"germanic": ["de", "en"], "qq": ["qq"], "romance": ["es", "fr"]}
    assert model.weights.shape[1] == 3 + 2  # one per family, one per pair within a family
    told = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang == r.lang_pred for r in told)


def test_margins_are_mean_weights():
    rng = np.random.default_rng(0)
    model = language.Model({"a": ["a"]}, rng.normal(size=(1 << 8, 3)).astype(np.float32), np.array([1.0, 2.0, 3.0]), 8)
    texts = [b"abc", b"", b"some text here", b"z"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = language.margins(model, data, offsets)
    for t, row in zip(texts, got):
        found = np.concatenate([language.buckets(np.frombuffer(t, np.uint8), order, 8) for order in language.ORDERS])
        want = model.weights[found].mean(axis=0) if len(found) else 0
        assert np.allclose(row, want + model.bias, atol=1e-5)


def test_no_labels_and_no_rows(odd, nothing):
    empty = model_of(nothing)
    assert empty.families == {} and language.identify(nothing, empty).count() == 0
    assert {(r.lang_pred, r.score) for r in language.identify(odd, empty).collect()} == {("und", 0.0)}
    one = language.fit(odd.where("lang = 'ja'"), F.col("text"), F.col("lang"), F.col("doc_id"), bits=8)
    assert {r.lang_pred for r in language.identify(odd, one).collect()} == {"ja", "und"}
