"""Quality rules: countable properties of a text, and a hashed n-gram log-likelihood ratio between a trusted and the raw corpus.

Each word and each pair of neighbouring words is hashed into one of 2 ** bits buckets. Two multinomials over the
buckets, one of the trusted documents and one of all documents, give every bucket the weight log p(trusted) / p(raw);
a document's ratio is the mean weight of its n-grams. Counts cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import arrays

SYMBOLS = b"#*$%&|<>"
RULE_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def ngrams(words: arrays.Spans, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words (h: their hashes) and of the pairs of neighbouring words, and the documents they are in."""
    same = words.doc[1:] == words.doc[:-1]
    pairs = arrays.mixed(h[:-1] * arrays.MULTIPLIER + h[1:])[same]
    shift = np.uint64(64 - bits)
    return (np.concatenate((h, pairs)) >> shift).astype(np.int64), np.concatenate((words.doc, words.doc[1:][same]))


def counter(bits: int):
    """Rows (bucket, trusted, raw) of the n-grams of a task's documents; memory is two arrays of 2 ** bits counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            data, offsets = arrays.flat(batch.column(0))
            trusted = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for a, b in arrays.chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                words = arrays.words(part, offsets[a : b + 1] - offsets[a])
                bucket, doc = ngrams(words, arrays.hashes(part, words), bits)
                totals[0] += np.bincount(bucket[trusted[a:b][doc]], minlength=1 << bits)
                totals[1] += np.bincount(bucket, minlength=1 << bits)
        seen = np.flatnonzero(totals[1])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(totals[0][seen]), pa.array(totals[1][seen])], ["bucket", "trusted", "raw"])

    return run


@dataclass(frozen=True)
class Ratio:
    """The weight of every bucket."""

    weights: np.ndarray
    bits: int


def fit(docs: DataFrame, text: Column, trusted: Column, *, bits: int = 16, smoothing: float = 10.0) -> Ratio:
    """The ratio between the documents for which `trusted` is true and all documents.

    Both multinomials are smoothed in proportion to their size: a bucket with trusted count t, where its share of the
    raw corpus lets one expect e, weighs log((t + smoothing) / (e + smoothing)), so rare n-grams say little either way.
    Null texts are empty; a null flag is false. With no trusted document or no word at all every weight is 0.
    What comes to the driver is one row per bucket, 2 ** bits at most.
    """
    counted = docs.select(text.alias("text"), trusted.alias("trusted")).mapInArrow(counter(bits), "bucket int, trusted long, raw long")
    rows = counted.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw")).toArrow()
    counts = np.zeros((2, 1 << bits))
    counts[:, rows.column("bucket").to_numpy()] = rows.column("trusted").to_numpy(), rows.column("raw").to_numpy()
    if not counts[0].sum():
        return Ratio(np.zeros(1 << bits, np.float32), bits)
    expected = counts[1] * (counts[0].sum() / counts[1].sum())
    return Ratio(np.log((counts[0] + smoothing) / (expected + smoothing)).astype(np.float32), bits)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def measures(data: np.ndarray, offsets: np.ndarray, words: arrays.Spans, hashes: np.ndarray) -> list[np.ndarray]:
    """The columns of RULE_COLUMNS for each row."""
    n = len(offsets) - 1
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate(([0], np.cumsum(symbol[data], dtype=np.int32)))
    salt = arrays.mixed(np.arange(1, n + 1, dtype=np.uint64))

    lines = arrays.runs(data != 0x0A, offsets)
    dark = np.concatenate(([0], np.cumsum(~arrays.WHITE[data], dtype=np.int32)))
    _, later = _repeats(arrays.mixed(arrays.hashes(data, lines) + salt[lines.doc]))
    later &= dark[lines.end] > dark[lines.start]

    h = hashes + salt[words.doc]
    repeated = np.zeros(len(h), bool)
    if len(h) > 2:
        inside = words.doc[2:] == words.doc[:-2]
        key = arrays.mixed(arrays.mixed(arrays.mixed(h[:-2]) + h[1:-1]) + h[2:])
        again = np.zeros(len(key), bool)
        again[inside] = _repeats(key[inside])[0]
        for k in range(3):
            repeated[k : len(again) + k] |= again
    count = lambda doc, values=None: np.bincount(doc, weights=values, minlength=n).astype(np.int64)
    return [
        count(words.doc),
        count(words.doc, chars[words.end] - chars[words.start]),
        symbols[offsets[1:]] - symbols[offsets[:-1]],
        count(lines.doc[later]),
        count(words.doc[repeated]),
    ]


def judge(docs: DataFrame, ratio: Ratio, *, key: str = "doc_id", text: str = "text", min_words: int = 50, most_repeated: int = 50, threshold: float = -0.08) -> DataFrame:
    """One row per document: key, the measures, `ratio` (mean log ratio of its n-grams, 0 if it has none), `base_failed`, `kept`.

    A document fails the base rules with fewer than min_words words, or with more than most_repeated percent of its
    words in repeated 3-word windows. It is kept if it passes them and its ratio is at least `threshold`; nothing is
    drawn at random, so equal texts get equal verdicts. Null and empty texts have no words and fail. Null or repeated
    keys are carried along. Empty input gives no rows; other columns are not read.
    """
    weights, bits = ratio.weights, ratio.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.flat(batch.column(1))
            for a, b in arrays.chunks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words = arrays.words(part, at)
                h = arrays.hashes(part, words)
                bucket, doc = ngrams(words, h, bits)
                total = np.bincount(doc, weights=weights[bucket], minlength=b - a)
                mean = total / np.maximum(np.bincount(doc, minlength=b - a), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, measures(part, at, words, h)), pa.array(mean)], names)

    names = [key, *(c.split()[0] for c in RULE_COLUMNS.split(", ")), "ratio"]
    kind = docs.select(key).schema[0].dataType.simpleString()
    told = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {RULE_COLUMNS}, ratio double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return told.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= threshold))
