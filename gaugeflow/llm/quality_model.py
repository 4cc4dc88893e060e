"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (64 words each). Every passage is encoded as the frequencies of neighbouring byte kinds
(lower, upper, digit, symbol, ...) and a few ratios. A gated attention (tanh times sigmoid) gives each passage a weight,
the weighted passages make the document's representation, and a logistic unit scores it. Labels are known by document
only, so attention weights are learned from those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import arrays
from gaugeflow.llm.sampling import per_class

PASSAGE_WORDS = 64


def _kinds() -> np.ndarray:
    kind = np.full(256, 11, np.uint8)  # other ASCII
    for k, members in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (9, 10, 11, 12, 13), b".,;:?'\"-()", b"!", b"#*$%&<>", b"|", range(0x80, 0xA0), range(0xA0, 0xC0))):
        kind[list(members)] = k
    kind[0xC0:] = 12
    return kind


KIND = _kinds()
KINDS = 13
RATIOS = 5
WIDTH = KINDS * KINDS + RATIOS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages, and the row of each; a row without words has one passage of zeros."""
    rows = len(offsets) - 1
    words = arrays.words(data, offsets)
    h = arrays.hashes(data, words)
    first_word = np.searchsorted(words.doc, np.arange(rows))  # of each row
    n_words = np.bincount(words.doc, minlength=rows)
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())
    row = np.repeat(np.arange(rows), n_passages)
    out = np.zeros((total, WIDTH), np.float32)
    if len(h):
        place = np.arange(len(h)) - first_word[words.doc]
        passage = first[words.doc] + place // PASSAGE_WORDS
        starts = np.flatnonzero(place % PASSAGE_WORDS == 0)
        begin, at = words.start[starts], passage[starts]  # a passage runs from its first word to the next passage
        end = np.concatenate((begin[1:], [len(data)]))
        end = np.where(np.concatenate((words.doc[starts][1:] != words.doc[starts][:-1], [True])), offsets[words.doc[starts] + 1], end)
        length = end - begin
        of = np.repeat(at, length)
        byte = np.arange(int(length.sum())) + np.repeat(begin - np.cumsum(length) + length, length)
        kind = KIND[data[byte]]
        inside = of[1:] == of[:-1]
        cell = of[:-1] * (KINDS * KINDS) + kind[:-1].astype(np.int64) * KINDS + kind[1:]
        pairs = np.bincount(cell[inside], minlength=total * KINDS * KINDS).reshape(total, -1)
        out[:, : KINDS * KINDS] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
        count = np.bincount(passage, minlength=total)
        size = np.maximum(count, 1)
        key = np.sort(arrays.mixed(h + arrays.mixed(passage.astype(np.uint64) + np.uint64(1))))
        order = np.argsort(arrays.mixed(h + arrays.mixed(passage.astype(np.uint64) + np.uint64(1))), kind="stable")
        new = np.concatenate(([True], key[1:] != key[:-1]))
        distinct = np.bincount(passage[order[new]], minlength=total)
        beside = np.bincount(passage[1:][(h[1:] == h[:-1]) & (passage[1:] == passage[:-1])], minlength=total)
        chars = np.bincount(passage, weights=words.end - words.start, minlength=total)
        out[:, KINDS * KINDS :] = np.stack([distinct / size, beside / size, chars / size / 10, np.log1p(count) / 4, count > 0], axis=1)
    return out, row


@dataclass(frozen=True)
class Model:
    """Parameters of the network; `order` names them."""

    centre: np.ndarray
    spread: np.ndarray
    parameters: tuple[np.ndarray, ...]  # V, v, U, u (attention), a (its outlet), w, b (score)
    prior: float | None = None  # the score of every document where the labels are all alike or missing

    def scores(self, x: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        if self.prior is not None:
            return np.full(rows, self.prior)
        return _forward(self.parameters, (x - self.centre) / self.spread, np.searchsorted(row, np.arange(rows)))[0]


def _forward(parameters, x, starts):
    V, v, U, u, a, w, b = parameters
    t, g = np.tanh(x @ V + v), 1 / (1 + np.exp(-np.clip(x @ U + u, -30, 30)))
    e = np.clip((t * g) @ a, -30, 30)
    size = np.diff(np.append(starts, len(x)))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), size))
    alpha = e / np.repeat(np.add.reduceat(e, starts), size)
    z = np.add.reduceat(alpha[:, None] * x, starts)
    p = 1 / (1 + np.exp(-np.clip(z @ w + b[0], -30, 30)))
    return p, (t, g, alpha, z, size)


def train(x: np.ndarray, row: np.ndarray, y: np.ndarray, *, hidden: int, steps: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, ...]:
    """Adam on the mean log loss of bags, in about `steps` batches of 256 bags."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    scale = 1 / np.sqrt(d)
    p = [rng.normal(0, scale, (d, hidden)), np.zeros(hidden), rng.normal(0, scale, (d, hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(d), np.zeros(1)]
    p = [q.astype(np.float32) for q in p]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    starts = np.searchsorted(row, np.arange(len(y)))
    sizes = np.diff(np.append(starts, len(x)))
    step = 0
    batches = max(1, len(y) // 256)
    for _ in range(-(-steps // batches)):
        order = rng.permutation(len(y))
        for at in np.array_split(order, batches):
            step += 1
            size = sizes[at]
            begin = np.cumsum(size) - size
            xs = x[np.arange(size.sum()) - np.repeat(begin - starts[at], size)]
            out, (t, g, alpha, z, _) = _forward(p, xs, begin)
            dl = ((out - y[at]) / len(at)).astype(np.float32)
            dz = dl[:, None] * p[5]
            da = (np.repeat(dz, size, axis=0) * xs).sum(axis=1)
            de = alpha * (da - np.repeat(np.add.reduceat(alpha * da, begin), size))
            dt, dg = de[:, None] * p[4] * g * (1 - t * t), de[:, None] * p[4] * t * g * (1 - g)
            grads = [xs.T @ dt, dt.sum(0), xs.T @ dg, dg.sum(0), (t * g).T @ de, z.T @ dl, np.array([dl.sum()])]
            for q, gq, mq, sq in zip(p, grads, m, s):
                gq = gq + decay * q
                mq += 0.1 * (gq - mq)
                sq += 0.001 * (gq * gq - sq)
                q -= rate * (mq / (1 - 0.9**step)) / (np.sqrt(sq / (1 - 0.999**step)) + 1e-8)
    return tuple(p)


def encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, encodings of the passages as float32)."""
    for batch in batches:
        data, offsets = arrays.flat(batch.column(1))
        for a, b in arrays.chunks(offsets):
            x, row = passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            cut = np.searchsorted(row, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", each: int = 1500, hidden: int = 16, steps: int = 400, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Model:
    """A model from about `each` documents of either label (the only bound), with labels (key, label: 0 or 1) by key.
    Keys are drawn first, then rows of these keys.

    The executors encode whole texts of the sample; their passages (about 700 bytes each) come to the driver, which
    trains. Keys with several labels take the lower one; null keys and labels are left out. Where only one label is
    found every document scores that label, and 0.5 where none is.
    """
    told = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("label"))
    chosen = per_class(told, "label", each)  # about 2 * each keys
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("label", "text")
    rows = per_class(rows, "label", each)  # a key may be that of many rows
    found = rows.mapInArrow(encoder, "label int, bag binary").toArrow().sort_by([("label", "ascending"), ("bag", "ascending")])
    y = found.column("label").to_numpy()
    if len(set(y)) < 2:
        return Model(np.zeros(0), np.zeros(0), (), float(y[0]) if len(y) else 0.5)
    bags = [np.frombuffer(bag, np.float32).reshape(-1, WIDTH) for bag in found.column("bag").to_pylist()]
    x, row = np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
    centre, spread = x.mean(axis=0), x.std(axis=0) + 0.01
    return Model(centre, spread, train((x - centre) / spread, row, y.astype(np.float32), hidden=hidden, steps=steps, rate=rate, decay=decay, seed=seed))


def quality(text: Column, model: Model) -> Column:
    """The score of a text, from 0 to 1; null and empty texts are one passage of zeros and score like any other bag."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        data, offsets = arrays.flat(texts)
        found = [np.zeros(0)]
        for a, b in arrays.chunks(offsets):
            x, row = passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            found.append(model.scores(x, row, b - a).astype(np.float64))
        return pa.array(np.concatenate(found))

    return run(text)


def score(docs: DataFrame, model: Model, *, text: str = "text", carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """Every document: `row` (a struct of the columns named in carry) and `score`, from 0 to 1.

    Only the text is looked at, whole; equal texts score alike. Null or repeated keys and extra columns are carried
    along; empty input gives no rows.
    """
    return docs.select(F.struct(*carry).alias("row"), quality(F.col(text), model).alias("score"))
