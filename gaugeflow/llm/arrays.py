"""Texts of an Arrow batch as flat byte arrays: words, lines and their hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True  # the class [\x20\x09-\x0D]
CHUNK_BYTES = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_KEYS = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.cumprod(np.full(64, MULTIPLIER, np.uint64))]


class Spans(NamedTuple):
    """Half-open ranges of a flat byte array and the document each belongs to."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):  # no chunk at all
        texts = pa.array([], pa.large_binary())
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes, so that work arrays stay in cache; a longer row is a run of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, rows)
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> Spans:
    """Maximal runs of marked bytes; none crosses a row."""
    if not len(inside):
        return Spans(*(np.zeros(0, np.int64),) * 3)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    return Spans(start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, start, "right") - 1)


def words(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """The matches of [^\\x20\\x09-\\x0D]+."""
    return runs(~WHITE[data], offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    if n > len(_POWERS[0]):
        _POWERS[0] = np.cumprod(np.full(2 * n, MULTIPLIER, np.uint64))
    return _POWERS[0]


def hashes(data: np.ndarray, spans: Spans) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (spans ascend, do not overlap, and are not empty)."""
    if not len(spans.start):
        return np.zeros(0, np.uint64)
    length = spans.end - spans.start
    begins = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(begins, length)
    own = data[within + np.repeat(spans.start, length)]
    terms = _BYTE_KEYS[own] * _powers(int(length.max()))[within]
    return mixed(np.add.reduceat(terms, begins) + length.astype(np.uint64))
