"""Language-model scores by a weighted backoff automaton.

Words are tokens, each text ends with one end token. The model is of order three, each order smoothed towards the next:

    P(x | u v) = (c(u v x) + k P(x | v)) / (c(u v) + k)      P(x | v) = (c(v x) + m P(x)) / (c(v) + m)
    P(x) = (c(x) - D) / N for known words, D V / N for the unknown one

As an automaton: a state per word pair and per word seen in training (the longest history known) and one without
history; a state's arcs, sorted by word, are the n-grams seen in training, with their smoothed probabilities as weights.
Where a state has no arc for a word, its failure arc is taken, of weight k / (c(u v) + k) or m / (c(v) + m), to the state
of the shorter history, until an arc is found. A text is read from left to right: the state before a word is that of the
longest known history, which is where the arc of the word before has led. A text starts in the state of the end token.

The automaton of a large corpus fits no task. Every block of documents asks for the counts of its own distinct words
and pairs, then of its triples, which are all the states and arcs that its texts can visit, and traverses that part.
Triples are asked for only if both their pairs occur in other blocks too and in training: otherwise the block knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import arrays, blocks

WORDS, PAIRS, TRIPLES = 0, 1, 2
END = np.uint64(0x51ED270B4D2C6A97)  # the end token's key; also the history of a text's first word


@dataclass(frozen=True)
class Totals:
    """Of the training tokens: all, distinct, those seen once and twice."""

    tokens: int
    distinct: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts of a block (ends included), the key before each, their document, and the documents' first positions."""
    data, offsets = arrays.flat(table.column("text"))
    keys, docs = [], []
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for a, b in arrays.chunks(offsets):
        part, at = lower[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        words = arrays.words(part, at)
        keys.append(arrays.hashes(part, words))
        docs.append(words.doc + a)
    n = len(offsets) - 1
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    place = np.arange(len(key)) + doc
    out, of = np.full(len(key) + n, END, np.uint64), np.empty(len(key) + n, np.int64)
    ends = np.cumsum(np.bincount(doc, minlength=n) + 1) - 1 if n else np.zeros(0, np.int64)
    out[place], of[place], of[ends] = key, doc, np.arange(n)
    first = np.concatenate(([0], ends[:-1] + 1)) if n else ends
    before = np.concatenate(([END], out[:-1]))
    return out, before, of, first


def _pairs(before: np.ndarray, key: np.ndarray) -> np.ndarray:
    return arrays.mixed(arrays.mixed(before) * arrays.MULTIPLIER + key)


class _Grams(NamedTuple):
    """The tokens of a block, numbered: distinct words and pairs with their keys, their number at each token and their training counts here."""

    of: np.ndarray
    first: np.ndarray  # whether a token is its text's first, so has no pair before it
    trained: np.ndarray
    keys: tuple[np.ndarray, np.ndarray]
    at: tuple[np.ndarray, np.ndarray]
    counts: tuple[np.ndarray, np.ndarray]
    triples: np.ndarray  # keys at each token; of no meaning at a first one


def _grams(table: pa.Table) -> _Grams:
    key, before, of, firsts = _tokens(table)
    trained = np.asarray(table.column("train").to_numpy(), bool)[of] if len(of) else np.zeros(0, bool)
    pairs = _pairs(before, key)
    found = [np.unique(x, return_inverse=True) for x in (key, pairs)]
    counts = [_count(at, trained, len(own)) for own, at in found]
    first = np.zeros(len(key), bool)
    first[firsts] = True
    return _Grams(of, first, trained, *([x for x in zip(*found)]), tuple(counts), _pairs(np.concatenate(([END], pairs[:-1])), key))


def _count(at: np.ndarray, trained: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=trained, minlength=n).astype(np.uint32)


def _question(buckets: int):
    def run(table: pa.Table, _) -> Iterator[tuple[int, int, bytes]]:
        grams = _grams(table)
        for kind in (WORDS, PAIRS):
            yield from _sent(kind, grams.keys[kind], grams.counts[kind], buckets)

    return run


def _sent(kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    for bucket, a, b in blocks.dealt(keys, buckets):
        yield kind, bucket, blocks.squeezed(blocks.differences(keys[a:b]), counts[a:b])


def _read(told: blocks.Answers, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """What the buckets said of ascending keys."""
    parts = [blocks.restored(told[kind, b][32:] if kind == WORDS else told[kind, b], "u8")[0] for b, _, _ in blocks.dealt(keys, buckets)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _pair_counts(told: blocks.Answers, grams: _Grams, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training counts of the pairs; at each token, whether its triple may have been seen in training, and whether other blocks must be asked."""
    said = _read(told, PAIRS, grams.keys[PAIRS], buckets)
    count, alone, at = said >> np.uint64(1), (said & np.uint64(1)).astype(bool), grams.at[PAIRS]
    previous = np.concatenate((at[:1], at[:-1]))
    seen = ~grams.first & (count[previous] > 0) & (count[at] > 0)
    return count, seen, seen & ~alone[previous] & ~alone[at]


def _question_of_triples(buckets: int):
    def run(table: pa.Table, told: blocks.Answers) -> Iterator[tuple[int, int, bytes]]:
        grams = _grams(table)
        _, _, ask = _pair_counts(told, grams, buckets)
        own, at = np.unique(grams.triples[ask], return_inverse=True)
        yield from _sent(TRIPLES, own, _count(at, grams.trained[ask], len(own)), buckets)

    return run


def _answer(kind: int, payloads: list[bytes]) -> list[bytes]:
    """Each block's keys' counts in the corpus: for words, the first payload also carries the bucket's totals; for pairs, the lowest bit tells
    that no other block has the pair."""
    parts = [blocks.restored(p, "u8", "u4") for p in payloads]
    sizes = [len(k) for k, _ in parts]
    keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts])
    own, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(own)).astype(np.uint64)
    said = total if kind != PAIRS else total << np.uint64(1) | (np.bincount(at, minlength=len(own)) == 1).astype(np.uint64)
    cut = np.cumsum([0, *sizes])
    told = [blocks.squeezed(said[at[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
    if kind != WORDS:
        return told
    own_totals = np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.int64).tobytes()
    return [(own_totals if i == 0 else bytes(32)) + x for i, x in enumerate(told)]


def _totals(answers: DataFrame) -> Totals:
    """Sums of what the buckets told; one row comes to the driver."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(4, np.int64)
        for batch in batches:
            for head in batch.column(0).to_pylist():
                sums += np.frombuffer(head, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in sums], ["a", "b", "c", "d"])

    heads = answers.where(F.col("kind") == WORDS).select(F.substring("payload", 1, 32).alias("head"))
    row = heads.mapInArrow(read, "a long, b long, c long, d long").groupBy().sum().first()
    return Totals(*(int(x or 0) for x in row))


@dataclass(frozen=True)
class _Automaton:
    """The part of the automaton that a block's texts can visit. State 0 has no history, then come words, then pairs."""

    arcs: np.ndarray  # state * words + word, ascending
    weight: np.ndarray  # log10, of each arc
    shorter: np.ndarray  # where a state's failure arc leads
    failure: np.ndarray  # its log10 weight
    unknown: float  # log10 weight of a word that has no arc even without history
    words: int

    def walk(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log10 weight of reading each word from the state before it: failure arcs as long as there is no arc for the word."""
        told, open_, state = np.zeros(len(word)), np.arange(len(word)), state.copy()
        while len(open_):
            code = state * self.words + word[open_]
            place = np.minimum(np.searchsorted(self.arcs, code), max(len(self.arcs) - 1, 0))
            found = self.arcs[place] == code if len(self.arcs) else np.zeros(len(code), bool)
            told[open_[found]] += self.weight[place[found]]
            lost = ~found & (state == 0)
            told[open_[lost]] += self.unknown
            on = ~found & (state > 0)
            open_, state = open_[on], state[on]
            told[open_] += self.failure[state]
            state = self.shorter[state]
        return told


def _automaton(totals: Totals, strengths: tuple[float, float], grams: _Grams, word_count: np.ndarray, pair_count: np.ndarray, triple_count: np.ndarray) -> tuple[_Automaton, np.ndarray]:
    """The automaton from the counts of words, pairs, and of the triple at each token; and the state before each token."""
    n, d, (m, k) = totals.tokens, totals.discount, strengths
    (words, pairs), (word, pair) = [len(x) for x in grams.keys], grams.at
    previous = np.concatenate((word[:1], word[:-1]))
    end = np.searchsorted(grams.keys[WORDS], END)
    history = np.where(grams.first, end, previous)
    some = np.zeros(pairs, np.int64)
    some[pair] = np.arange(len(pair))  # a token that ends each pair
    one, two = history[some], word[some]
    unigram = np.where(word_count > 0, (word_count - d) / n, d * totals.distinct / n)
    bigram = (pair_count + m * unigram[two]) / (word_count[one] + m)
    pair_before = np.concatenate((pair[:1], pair[:-1]))
    held = np.flatnonzero((triple_count > 0) & ~grams.first)
    code, at = np.unique((1 + words + pair_before[held]) * words + word[held], return_index=True)
    held = held[at]
    trigram = (triple_count[held] + k * bigram[pair[held]]) / (pair_count[pair_before[held]] + k)
    known, met = np.flatnonzero(word_count > 0), np.flatnonzero(pair_count > 0)
    by_state = np.argsort((1 + one[met]) * words + two[met])
    met = met[by_state]
    arcs = np.concatenate((known, (1 + one[met]) * words + two[met], code))
    weight = np.log10(np.concatenate((unigram[known], bigram[met], trigram)))
    shorter = np.concatenate(([0], np.zeros(words, np.int64), 1 + two))
    failure = np.log10(np.concatenate(([1.0], m / (word_count + m), k / (pair_count + k))))
    short = np.where(word_count[history] > 0, 1 + history, 0)
    state = np.where(~grams.first & (pair_count[pair_before] > 0), 1 + words + pair_before, short)
    return _Automaton(arcs, weight, shorter, failure, float(np.log10(d * totals.distinct / n)), words), state


def _traverse(totals: Totals, buckets: int, strengths: tuple[float, float]):
    n, v = totals.tokens, totals.distinct

    def run(table: pa.Table, told: blocks.Answers) -> pa.Table:
        grams, rows = _grams(table), table.num_rows
        word = grams.at[WORDS]
        word_count = _read(told, WORDS, grams.keys[WORDS], buckets).astype(np.float64)
        if n:
            pair_count, seen, asked = _pair_counts(told, grams, buckets)
            triple_count = np.zeros(len(word))
            own, at = np.unique(grams.triples[asked], return_inverse=True)
            triple_count[asked] = _read(told, TRIPLES, own, buckets)[at]
            here = seen & ~asked
            own, at = np.unique(grams.triples[here], return_inverse=True)
            triple_count[here] = _count(at, grams.trained[here], len(own))[at]
            automaton, state = _automaton(totals, strengths, grams, word_count, pair_count.astype(np.float64), triple_count)
            base, step = np.log10((word_count + 1) / (n + v + 1))[word], automaton.walk(state, word)
        else:
            base = step = np.zeros(len(word))
        add = lambda x: np.bincount(grams.of, weights=x, minlength=rows)
        columns = [table.column(c) for c in table.column_names if c not in ("train", "text")]
        told_columns = [
            pa.array(np.bincount(grams.of, minlength=rows)), pa.array(add(word_count[word] > 0).astype(np.int64)),
            pa.array(np.full(rows, n, np.int64)), pa.array(add(base)), pa.array(add(step)),
        ]
        return pa.table([*columns, *told_columns], [*(c for c in table.column_names if c not in ("train", "text")), "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, train: Column, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), strengths: tuple[float, float] = (200.0, 8.0), block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """The columns named in carry and `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` of every document.

    The documents for which `train` is true make the model, with all their words; a null counts as false. `score` is
    the log10 probability of the text's tokens, `base_score` that of an add-one unigram model; both treat all unknown
    words as one. `strengths` are m and k above (chosen on texts kept apart from training). Null and empty texts are one end token. Without training documents both scores
    are 0. Repeated rows count each; empty input gives no rows. Words are told apart by a 64-bit hash.
    The packed blocks stay persisted for the result, until blocks.release(spark).
    """
    columns = [*(F.col(c) for c in carry), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    packed = blocks.packed(docs, columns, block_bytes)
    buckets = blocks.bucket_count(packed)
    answers = blocks.answered(blocks.asked(packed, _question(buckets)), _answer)
    triples = blocks.answered(blocks.asked(packed, _question_of_triples(buckets), answers.where(F.col("kind") == PAIRS)), _answer)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields)
    schema = f"{fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.finished(packed, _traverse(_totals(answers), buckets, strengths), schema, answers.unionByName(triples))
