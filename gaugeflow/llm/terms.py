"""Terms of texts as Arrow arrays: maximal runs of the bytes of a class, A-Z lower-cased, without a Python loop over words.

In UTF-8 every byte of a character beyond ASCII is at least 0x80, so a class of characters that holds all of those is a
class of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gaugeflow.llm import arrays

PIECE_BYTES = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LETTERS = np.zeros(256, bool)  # [^\x00-\x40\x5B-\x60\x7B-\x7F]
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
WORD_CHARACTERS = LETTERS.copy()  # [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]
WORD_CHARACTERS[0x30:0x3A] = True


def _cuts(text: np.ndarray, inside: np.ndarray, most: int) -> list[int]:
    """Where a long text is cut into pieces of about `most` bytes, never within a term."""
    at, out = 0, [0]
    while len(text) - at > most:
        at += most
        while at < len(text) and inside[text[at]]:
            found = np.flatnonzero(~inside[text[at : at + most]])
            at += int(found[0]) if len(found) else min(most, len(text) - at)
        out.append(at)
    return [*out, len(text)] if out[-1] < len(text) else out


def pieces(texts: pa.Array | pa.ChunkedArray, inside: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(terms, row of each term): the terms of a column of texts, about `most` bytes of text at a time.

    Terms of one row come in consecutive pieces where the row is longer. Null rows have no terms.
    """
    data, offsets = arrays.flat(texts)
    for a, b in arrays.chunks(offsets, most):
        part, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        if b - a == 1 and len(part) > most:
            cuts = _cuts(part, inside, most)
            for first, last in zip(cuts[:-1], cuts[1:]):
                yield _terms(part[first:last], np.array([0, last - first]), inside, a)
        else:
            yield _terms(part, at, inside, a)


def _terms(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, first_row: int) -> tuple[pa.Array, np.ndarray]:
    spans = arrays.runs(inside[data], offsets)
    edges = np.empty(2 * len(spans.start), np.int64)
    edges[0::2], edges[1::2] = spans.start, spans.end
    return between(data, edges), spans.doc + first_row


def between(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes data[edges[0]:edges[1]], data[edges[1]:edges[2]], ...: terms at even places, what parts them at odd ones.

    Nothing is copied; whoever reads the result takes every second entry.
    """
    n = max(0, len(edges) - 1)
    buffers = [None, pa.py_buffer(np.ascontiguousarray(edges if n else np.zeros(1, np.int64))), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), n, buffers)


def numbered(terms: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each term, and the distinct terms (and separators) the numbers stand for."""
    coded = terms.dictionary_encode()
    return coded.indices.to_numpy()[0::2], coded.dictionary


def distinct(keys: np.ndarray, *more: np.ndarray, weights: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of the key columns in ascending order (first column last), and the sums of weights per row."""
    columns = (keys, *more)
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    if not len(order):
        return columns, [w[:0] for w in weights]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], [np.add.reduceat(w[order], first) for w in weights]
