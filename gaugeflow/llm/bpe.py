"""Byte-level BPE by merge replay, block by block of the corpus.

The distinct words of a block of documents are one array of tokens. An inverted index lists, for every rank, the
positions where a pair of neighbours merges at that rank. Ranks are taken in order; each is applied at all its positions
at once, and only the pairs with the touched neighbours are looked up and listed anew. Documents are then spelled from
their words. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import arrays

BLOCK_BYTES = 4 << 20
NONE = np.int32(2**31 - 1)
# White_Space of Unicode, spelled out: regex libraries differ in what \s holds.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Vocabulary:
    """Tokens by rank, and the rank at which any two tokens merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.size = size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.fromiter(map(len, tokens), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, NONE where they do not merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with its white space spelled out."""
    inside = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}")
    return regex.compile(inside.replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All words' tokens one after another, and how many each word has. A word that is a token is that token."""
    whole = np.fromiter((vocab.ranks.get(w, -1) for w in words), np.int32, len(words))
    open_words = [w for w, id in zip(words, whole.tolist()) if id < 0]
    sizes = np.fromiter(map(len, open_words), np.int64, len(open_words))
    token = vocab.byte_ids[np.frombuffer(b"".join(open_words), np.uint8)]
    n = len(token)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = np.cumsum(sizes)
    after[ends - 1] = -1
    before[ends - sizes] = -1
    rank, alive = np.full(n, NONE, np.int32), np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def post(at: np.ndarray) -> None:
        found = rank[at]
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        last = int(np.searchsorted(found, NONE))
        if not last:
            return
        cuts = [0, *(np.flatnonzero(found[1:last] != found[: last - 1]) + 1).tolist(), last]
        for a, b, r in zip(cuts[:-1], cuts[1:], found[cuts[:-1]].tolist()):
            if r in index:
                index[r].append(at[a:b])
            else:
                index[r] = [at[a:b]]
                heapq.heappush(queue, r)

    inner = np.flatnonzero(after >= 0).astype(np.int32)
    for part in np.array_split(inner, max(1, len(inner) >> 18)):
        rank[part] = vocab.merge(token[part], token[part + 1])
    post(inner)
    while queue:
        r = heapq.heappop(queue)
        lists = index.pop(r)
        left = lists[0] if len(lists) == 1 else np.concatenate(lists)
        left = left[rank[left] == r]
        if not len(left):
            continue
        left = np.unique(left)
        right = after[left]
        if (rank[right] == r).any():  # chains such as aaa: every second pair, from the left
            linked = np.concatenate(([False], left[1:] == right[:-1]))
            place = np.arange(len(left))
            keep = (place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 0
            left, right = left[keep], right[keep]
        beyond = after[right]
        token[left], after[left], alive[right], rank[right] = r, beyond, False, NONE
        follows = beyond >= 0
        before[beyond[follows]] = left[follows]
        rank[left] = NONE
        head, tail = left[follows], beyond[follows]
        rank[head] = vocab.merge(token[head], token[tail])
        ahead = before[left]
        has = ahead >= 0
        prior, own = ahead[has], left[has]
        rank[prior] = vocab.merge(token[prior], token[own])
        post(np.concatenate((head, prior)))
    counts = np.ones(len(words), np.int64)
    if len(open_words):
        counts[whole < 0] = np.add.reduceat(alive.astype(np.int64), ends - sizes)
    out = np.empty(int(counts.sum()), np.int32)
    starts = np.cumsum(counts) - counts
    known = whole >= 0
    out[starts[known]] = whole[known]
    if len(open_words):
        spread = np.ones(len(out), bool)
        spread[starts[known]] = False
        out[spread] = token[alive]
    return out, counts


def _ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length] one after another."""
    total = np.cumsum(length)
    return flat[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - length), length)]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of bytes of the given sizes."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode_block(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary, split: regex.Pattern) -> pa.Array:
    """The ids of every row as little-endian unsigned 32-bit integers."""
    number: dict[str, int] = {}
    codes, sizes = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        found = split.findall(data[a:b].tobytes().decode("utf-8", "replace"))
        codes.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
        sizes.append(len(found))
    words = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    flat, counts = replay([w.encode() for w in number], vocab)
    starts = np.cumsum(counts) - counts
    of_word = counts[words]
    total = np.concatenate(([0], np.cumsum(of_word)))
    cut = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return _binary(_ragged(flat, starts[words], of_word).astype("<u4"), 4 * np.diff(total[cut]))


def encode(docs: DataFrame, *, path: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns named in carry and `ids`, the token ids of the whole text as little-endian unsigned 32-bit integers.

    Each match of pattern is encoded on its own by the ranks in the file at path; no special tokens. Null and empty
    texts have no ids. Texts of any length are encoded whole; equal texts get equal ids; repeated rows stay; empty input
    gives no rows. The distinct words of a block of about 4 MB of text are in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, split = vocabulary(path), splitter(pattern)
        for batch in batches:
            data, offsets = arrays.flat(batch.column(len(carry)))
            for a, b in arrays.chunks(offsets, BLOCK_BYTES):
                found = encode_block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vocab, split)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(carry))), found], [*carry, ids])

    rows = docs.select(*carry, F.col(text).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{ids}` binary"]))


def decode(ids: Column, *, path: str) -> Column:
    """The bytes of ids packed as encode() packs them; null for null. Ids beyond the vocabulary have no bytes."""

    @F.arrow_udf("binary")
    def run(packed: pa.Array) -> pa.Array:
        vocab = vocabulary(path)
        data, offsets = arrays.flat(packed)
        out, sizes = [], []
        for a, b in arrays.chunks(offsets):
            found = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), "<u4").astype(np.int64)
            length = np.where(found < vocab.size, vocab.length[np.minimum(found, vocab.size - 1)], 0)
            out.append(_ragged(vocab.bytes, vocab.start[np.minimum(found, vocab.size - 1)], length))
            total = np.concatenate(([0], np.cumsum(length)))
            sizes.append(np.diff(total[(offsets[a : b + 1] - offsets[a]) // 4]))
        told = _binary(np.concatenate(out) if out else np.zeros(0, np.uint8), np.concatenate(sizes) if sizes else np.zeros(0, np.int64))
        return pa.array([x if ok else None for x, ok in zip(told.to_pylist(), packed.is_valid().to_pylist())], pa.binary()) if packed.null_count else told

    return run(ids)
