import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gaugeflow.llm import arrays, quality_model, quality_rules, queries
from llm_rows import frame, odd_rows

SF = "/root/testdata/sf0.01"


def test_classifier_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    told = queries.QUERIES["op9_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert len(told) > 50 and sum(r.quality == r.predicted for r in told) >= 0.93 * len(told)


def test_classifier_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = quality_model.fit(odd, labels)
    rows = quality_model.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and rows[0].row.asDict().keys() == set(odd.columns)
    same = {}
    for r in rows:
        same.setdefault(r.row.text or "", set()).add(round(r.score, 6))
    assert all(len(s) == 1 for s in same.values())
    assert quality_model.score(nothing, model).count() == 0
    assert {r.score for r in quality_model.score(odd, quality_model.fit(odd, labels.where("quality = 1"))).collect()} == {1.0}
    assert {r.score for r in quality_model.score(odd, quality_model.fit(nothing, labels)).collect()} == {0.5}


def test_attention_finds_the_passage():
    """Bags of plain passages, some with one odd passage: the label is of the bag, the weight goes to the passage."""
    rng = np.random.default_rng(0)
    x, row, y = [], [], []
    for i in range(300):
        bag = rng.normal(0, 1, (8, 6))
        y.append(i % 2)
        if i % 2:
            bag[rng.integers(8)] += (4, 0, 0, 0, 0, 0)
        x.append(bag)
        row += [i] * 8
    x, row = np.concatenate(x).astype(np.float32), np.array(row)
    p = quality_model.train(x, row, np.array(y, np.float32), hidden=8, steps=300, rate=0.01, decay=0, seed=1)
    out, (_, _, alpha, _, _) = quality_model._forward(p, x, np.arange(0, len(x), 8))
    assert ((out > 0.5) == np.array(y)).mean() > 0.9
    assert (alpha.reshape(-1, 8)[1::2].argmax(1) == x[:, 0].reshape(-1, 8)[1::2].argmax(1)).mean() > 0.8


def test_passages_are_whole_texts():
    texts = pa.array(["one two " * 100, "", None, "x"])
    x, row = quality_model.passages(*arrays.flat(texts))
    assert np.bincount(row).tolist() == [4, 1, 1, 1] and not x[4].any() and not x[5].any() and x[6].any()


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, nothing):
    rows = odd_rows() + [(400, "a\nb\na\n\n \n \na ", None, None), (401, "x x x x", None, None), (402, "é|<b> a b c a b c\na b", None, None)]
    docs = frame(spark, rows)
    ratio = quality_rules.fit(docs, F.col("text"), F.col("lang") == "en", bits=12)
    told = quality_rules.judge(docs, ratio).collect()
    by_id = {}
    for r in told:
        by_id.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.ratio >= -0.08)
    want = {}
    for k, t, *_ in rows:
        want.setdefault(k, []).append(measures(t))
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in want.items()}
    assert quality_rules.judge(nothing, ratio).count() == 0


def test_ratio_is_the_mean_log_ratio(spark):
    docs = frame(spark, [(1, "good words here", "en", None), (2, "bad bad words", "xx", None), (3, None, "en", None)])
    ratio = quality_rules.fit(docs, F.col("text"), F.col("lang") == "en", bits=16, smoothing=1.0)
    trusted, raw = Counter(["good", "words", "here", "good words", "words here"]), Counter(["good", "words", "here", "good words", "words here", "bad", "bad", "words", "bad bad", "bad words"])
    weight = {w: np.log((trusted[w] + 1) / (raw[w] * 5 / 10 + 1)) for w in raw}
    told = {r.doc_id: r.ratio for r in quality_rules.judge(docs, ratio).collect()}
    assert abs(told[1] - np.mean([weight[w] for w in ["good", "words", "here", "good words", "words here"]])) < 1e-6
    assert abs(told[2] - np.mean([weight[w] for w in ["bad", "bad", "words", "bad bad", "bad words"]])) < 1e-6 and told[3] == 0


def test_no_trusted_documents(odd, nothing):
    assert not quality_rules.fit(odd, F.col("text"), F.lit(None).cast("boolean")).weights.any()
    assert not quality_rules.fit(nothing, F.col("text"), F.lit(True)).weights.any()


def test_good_documents_are_kept(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    told = queries.QUERIES["op10_quality_rules"](spark, SF).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = ([r.kept for r in told if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
