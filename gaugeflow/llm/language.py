"""Language identification by hierarchical discrimination: the family first, then the language within it.

A text is the distribution of its hashed letter n-grams (1 to 4 bytes of the lower-cased text, everything but letters
as one space). Linear support vector machines, one against the rest, choose the family; within a family one machine per
pair of languages votes. All machines are fitted on a bounded sample per language and applied as one weight table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import arrays
from gaugeflow.llm.sampling import per_class

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
# ISO 639-1 codes by language family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@dataclass(frozen=True)
class Model:
    """Weight columns of every machine over the buckets: first one per family, then one per pair of languages."""

    families: dict[str, list[str]]
    weights: np.ndarray
    bias: np.ndarray
    bits: int


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes and row offsets, with every ASCII byte that is no letter as a space."""
    data, offsets = arrays.flat(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    keep = np.arange(256, dtype=np.uint8)
    keep[:128][[not (97 <= b <= 122) for b in range(128)]] = 0x20
    return keep[data], offsets


def buckets(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram of `order` bytes that starts at each byte but the last order - 1."""
    n = max(0, len(data) - order + 1)
    code = np.zeros(n, np.uint32)
    for k in range(order):
        code = (code << np.uint32(8)) | data[k : n + k]
    return (code * np.uint32(2654435769) + np.uint32(order * 0x9E37)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)


def _shares(data: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """For each row, the share of its n-grams in each bucket; for the few rows of the sample."""
    out = np.zeros((len(offsets) - 1, 1 << bits), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        found = np.concatenate([buckets(data[a:b], order, bits) for order in ORDERS])
        out[i] = np.bincount(found, minlength=1 << bits) / max(1, len(found))
    return out


def sample_features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = letters(batch.column(1))
            for a, b in arrays.chunks(offsets):
                share = _shares(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in share], pa.binary())], ["label", "share"])

    return run


def svm(x: np.ndarray, y: np.ndarray, *, epochs: int, penalty: float, seed: int) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss, averaged stochastic subgradients) for labels -1 and 1, classes weighed alike."""
    rng = np.random.default_rng(seed)
    weigh = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * len(y)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    mean_w, mean_b, step = np.zeros_like(w), 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in np.array_split(order, max(1, len(y) // 64)):
            step += 1
            rate = 1.0 / (penalty * (step + 100))
            bad = y[at] * (x[at] @ w + b) < 1
            pull = (weigh[at] * y[at] * bad).astype(np.float32)
            w = (1 - rate * penalty) * w + (rate / len(at)) * (pull @ x[at])
            b += rate * penalty * float(pull.mean())
            mean_w += (w - mean_w) / step
            mean_b += (b - mean_b) / step
    return mean_w, mean_b


def fit(docs: DataFrame, text: Column, label: Column, key: Column | None = None, *, each: int = 500, bits: int = 12, epochs: int = 20, penalty: float = 1e-3, seed: int = 1) -> Model:
    """A model from about `each` labelled documents per language; of many languages fewer each, see sampling.per_class.
    `key` is not looked at: rows are drawn, not keys.

    Whole texts of the sample are counted by the executors; one row of 2 ** bits shares per document comes to the
    driver, which fits the machines. Null labels are not used. Without any label the model has no family.
    """
    rows = docs.select(label.alias("label"), text.alias("text"))
    found = per_class(rows, "label", each).select("label", "text").mapInArrow(sample_features(bits), "label string, share binary").toArrow().sort_by([("label", "ascending"), ("share", "ascending")])
    labels = np.array(found.column("label").to_pylist(), object)
    families: dict[str, list[str]] = {}
    for language in sorted(set(labels)):
        families.setdefault(FAMILY_OF.get(language, language), []).append(language)
    families = dict(sorted(families.items()))
    if not families:
        return Model({}, np.zeros((1 << bits, 0), np.float32), np.zeros(0, np.float32), bits)
    x = np.frombuffer(b"".join(found.column("share").to_pylist()), np.float32).reshape(len(labels), -1)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-4
    x = (x - centre) / spread / np.sqrt(x.shape[1])
    family = np.array([FAMILY_OF.get(v, v) for v in labels], object)
    jobs = [(np.ones(len(labels), bool), np.where(family == f, 1, -1)) for f in families]
    jobs += [(np.isin(labels, pair), np.where(labels == pair[0], 1, -1)) for members in families.values() for pair in combinations(members, 2)]
    fitted = [svm(x[rows], y[rows], epochs=epochs, penalty=penalty, seed=seed) for rows, y in jobs]
    weights = np.stack([w / spread / np.sqrt(x.shape[1]) for w, _ in fitted], axis=1)
    return Model(families, np.ascontiguousarray(weights, np.float32), np.array([b for _, b in fitted]) - centre @ weights, bits)


def margins(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The margin of every machine for every row: its bias plus the mean weight of the row's n-grams."""
    rows = len(offsets) - 1
    total, count = np.zeros((rows, model.weights.shape[1])), np.zeros(rows)
    for order in ORDERS:
        found = buckets(data, order, model.bits)
        length = np.maximum(np.diff(offsets) - order + 1, 0)
        count += length
        for k in range(model.weights.shape[1]):
            sums = np.concatenate(([0.0], np.cumsum(model.weights[:, k][found], dtype=np.float64)))
            total[:, k] += np.where(length > 0, sums[np.minimum(offsets[:-1] + length, len(found))] - sums[np.minimum(offsets[:-1], len(found))], 0)
    return total / np.maximum(count, 1)[:, None] + model.bias


def decide(model: Model, margin: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language and a score from 0 to 1: the family's share times the mean certainty of the language's machines."""
    families = list(model.families)
    own = margin[:, : len(families)]
    share = np.exp(2 * (own - own.max(axis=1, keepdims=True)))
    share /= share.sum(axis=1, keepdims=True)
    best = own.argmax(axis=1)
    names, score, at = np.empty(len(margin), object), np.zeros(len(margin)), len(families)
    for f, members in enumerate(model.families.values()):
        sure = np.zeros((len(margin), len(members)))
        votes = np.zeros_like(sure)
        for i, j in combinations(range(len(members)), 2):
            p = 1 / (1 + np.exp(-2 * np.clip(margin[:, at], -50, 50)))
            at += 1
            sure[:, i] += p
            sure[:, j] += 1 - p
            votes[:, i] += p >= 0.5
            votes[:, j] += p < 0.5
        won = (votes + sure / (len(members) + 1)).argmax(axis=1)  # most pairs won, then the surer
        mean = sure[np.arange(len(margin)), won] / (len(members) - 1) if len(members) > 1 else np.ones(len(margin))
        rows = best == f
        names[rows] = np.array(members, object)[won[rows]]
        score[rows] = (share[:, f] * mean)[rows]
    return names.tolist(), score


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, `lang_pred`, `score` (0 to 1).

    Only the text is looked at, and all of it. Null, empty and letterless texts, and any text under a model without
    languages, are `und` with score 0. Equal texts get equal answers. Null or repeated keys are carried along; other
    columns are not read; empty input gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = letters(batch.column(1))
            worded = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in arrays.chunks(offsets):
                if not model.families:
                    names, score = [UNKNOWN] * (b - a), np.zeros(b - a)
                else:
                    names, score = decide(model, margins(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                ok = worded[a:b]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([n if k else UNKNOWN for n, k in zip(names, ok)], pa.string()), pa.array(np.where(ok, score, 0.0))], [key, "lang_pred", "score"]
                )

    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(key, text, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("worded"))
    return rows.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
