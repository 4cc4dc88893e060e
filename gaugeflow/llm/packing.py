"""Sum-of-squares packing of documents into windows of fixed size.

Documents come one after another. A level array counts the open windows of every fill level; a document goes to the
level (or into a new window) that makes the sum of the squared counts least. So no level piles up, and windows close
full. Open windows are bounded: beyond the bound, and at the end of a task, the emptiest are cut up to fill the fullest.
What a task has left is less than a window; it becomes sequences whose sizes are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
MOST_OPEN = 1024
MOST_WORDS = 1_200_000
WORDS_AT_ONCE = 1000
PART_CHARS = 1 << 20
TASK_SHIFT = 36


class _Numbers(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Words:
    """Ids of texts by a tokenizer that never looks beyond a space or a line feed: each distinct word is encoded once.

    White space is dropped before the vocabulary's merges, and normal forms and lower case do not reach across it, so
    the ids of a text are those of its words one after another. New words are encoded many at a time with BETWEEN, a
    word of its own, between them. When more than MOST_WORDS words are known they are forgotten.
    """

    BETWEEN = "\x01"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.edge = self._ids(self.BETWEEN)
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        self.number, self.known = _Numbers(), 0
        self.ids, self.start, self.length, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        last = self.known + len(sizes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while last > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.known : last] = self.used + np.cumsum(sizes) - sizes
        self.length[self.known : last] = sizes
        self.used, self.known = self.used + len(ids), last

    def _learn(self) -> None:
        new = list(islice(self.number, self.known, None))
        for a in range(0, len(new), WORDS_AT_ONCE):
            words = new[a : a + WORDS_AT_ONCE]
            joined = f" {self.BETWEEN} ".join(words)
            if len(self.edge) == 1 and joined.count(self.BETWEEN) == len(words) - 1:
                ids = np.array(self._ids(joined), np.uint32)
                inner = ids != self.edge[0]
                edges = np.flatnonzero(~inner)
                if len(edges) == len(words) - 1:
                    self._keep(ids[inner], np.diff(np.concatenate(([-1], edges, [len(ids)]))) - 1)
                    continue
            for word in words:  # some word holds BETWEEN, or what stands for it
                ids = np.array(self._ids(word), np.uint32)
                self._keep(ids, np.array([len(ids)]))

    def _spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        if self.known > MOST_WORDS:
            self._forget()
        code = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > self.known:
            self._learn()
        length = self.length[code]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.start[code] - (ends - length), length)], length

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text of any length, PART_CHARS of it at a time."""
        out, at = [], 0
        while at < len(text):
            end = at + PART_CHARS
            if end < len(text):  # the next space or line feed
                ends = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
                end = min(ends, default=len(text))
            out.append(self._spelled(text[at:end].replace("\n", " ").split(" "))[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """encode() of each text; short ones together."""
        held: list[list[str]] = []
        size = 0

        def close() -> Iterator[np.ndarray]:
            ids, length = self._spelled([w for words in held for w in words])
            cuts = np.concatenate(([0], np.cumsum(length)))[np.cumsum([len(words) for words in held[:-1]], dtype=np.int64)] if len(held) > 1 else []
            yield from np.split(ids, cuts)

        for text in texts:
            if held and size + len(text) > PART_CHARS:
                yield from close()
                held, size = [], 0
            if len(text) > PART_CHARS:
                yield self.encode(text)
                continue
            held.append(text.replace("\n", " ").split(" "))
            size += len(text)
        if held:
            yield from close()


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


class Piece(NamedTuple):
    """ids[start : start + len(ids)] of a document."""

    doc: object
    start: int
    ids: np.ndarray
    of: int


class Packer:
    """The windows of one task."""

    def __init__(self, size: int, most_open: int = MOST_OPEN):
        self.size, self.most_open, self.open = size, most_open, 0
        self.level = np.zeros(size + 1, np.int64)  # open windows by fill; entry `size` stays 0: full windows are closed
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size)]
        self.done: list[list[Piece]] = []

    def place(self, piece: Piece) -> None:
        """Into the fill level where the sum of squared counts becomes least; of equal ones the fullest."""
        n = len(piece.ids)
        levels = np.flatnonzero(self.level[: self.size - n + 1])
        levels = np.concatenate(([0], levels)) if self.level[0] == 0 else levels
        # leaving a level of c windows takes 2c - 1 from the sum, coming to one of c adds 2c + 1; a full window counts nowhere
        change = 2 * self.level[levels + n] + (levels + n < self.size) - np.where(levels > 0, 2 * self.level[levels] - 1, 0)
        best = int(levels[len(levels) - 1 - int(np.argmin(change[::-1]))])
        window = self.windows[best].pop() if best else []
        if best:
            self.level[best] -= 1
            self.open -= 1
        window.append(piece)
        if best + n == self.size:
            self.done.append(window)
            return
        self.level[best + n] += 1
        self.windows[best + n].append(window)
        self.open += 1
        if self.open > self.most_open:
            rest = self.fill()
            if rest:
                self._keep(rest)

    def _keep(self, window: list[Piece]) -> None:
        fill = sum(len(p.ids) for p in window)
        self.level[fill] += 1
        self.windows[fill].append(window)
        self.open += 1

    def add(self, doc: object, ids: np.ndarray) -> None:
        """A document: full windows of a long one by themselves, the rest by place()."""
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            self.done.append([Piece(doc, at, ids[at : at + self.size], len(ids))])
        if whole < len(ids):
            self.place(Piece(doc, whole, ids[whole:].copy() if whole else ids, len(ids)))

    def fill(self) -> list[Piece]:
        """Close all open windows: the pieces of the emptiest, cut where need be, fill the fullest. What is left, less than a window."""
        queue = [w for at in self.windows for w in at]
        self.windows, self.open = [[] for _ in range(self.size)], 0
        self.level[:] = 0
        loose: list[Piece] = []
        while queue:
            window = queue.pop()
            room = self.size - sum(len(p.ids) for p in window)
            while room and (loose or queue):
                if not loose:
                    loose = queue.pop(0)
                piece = loose.pop()
                if len(piece.ids) > room:
                    loose.append(Piece(piece.doc, piece.start + room, piece.ids[room:], piece.of))
                    piece = Piece(piece.doc, piece.start, piece.ids[:room], piece.of)
                window.append(piece)
                room -= len(piece.ids)
            if room:
                return window
            self.done.append(window)
        if not loose:
            return []
        return loose

    def end(self) -> None:
        """Close everything; the rest becomes sequences of 2 ** k ids, which need no padding."""
        rest = self.fill()
        left = sum(len(p.ids) for p in rest)
        for k in range(left.bit_length() - 1, -1, -1):
            if not left >> k & 1:
                continue
            window, room = [], 1 << k
            while room:
                piece = rest.pop()
                if len(piece.ids) > room:
                    rest.append(Piece(piece.doc, piece.start + room, piece.ids[room:], piece.of))
                    piece = Piece(piece.doc, piece.start, piece.ids[:room], piece.of)
                window.append(piece)
                room -= len(piece.ids)
            self.done.append(window)


def pack(docs: DataFrame, *, path: str, end_id: int, size: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of PIECES: where each run of ids of each document lies.

    A document's ids are those of the tokenizer in the file at path, without special tokens added, then end_id; a null
    or empty text has just that. Strings of special tokens within a text become those tokens, as the tokenizer itself
    has it. The tokenizer must drop spaces and line feeds, as Words says. Each id lies in exactly one piece; pieces of a
    sequence lie one after another. Sequences hold `size` ids; each task leaves less than one such, as sequences whose
    sizes are powers of two, so there is no padding. A document is cut only if longer than a sequence, or to fill one
    when windows are closed. Null and repeated keys are carried along, each row is a document of its own; equal texts
    are packed each for itself. Empty input gives no rows; other columns are not read. Sequence numbers are made of the
    task's number and so stay the same if a task runs again. A task holds at most MOST_OPEN open windows, one document
    and MOST_WORDS words.
    """

    def rows(done: list[list[Piece]], first: int) -> pa.RecordBatch:
        flat = [(p, first + i, at) for i, w in enumerate(done) for p, at in zip(w, np.cumsum([0, *(len(p.ids) for p in w[:-1])]).tolist())]
        columns = [
            pa.array([p.doc for p, _, _ in flat], pa.int64()),
            *(pa.array(x, pa.int64()) for x in zip(*((p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.of, s, at) for p, s, at in flat))),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = words_of(path), Packer(size)
        number = TaskContext.get().partitionId() << TASK_SHIFT
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode_all(texts)):
                packer.add(doc, np.append(ids, np.uint32(end_id)))
                if len(packer.done) >= 1000:
                    yield rows(packer.done, number)
                    number, packer.done = number + len(packer.done), []
        packer.end()
        if packer.done:
            yield rows(packer.done, number)

    return docs.select(key, text).mapInArrow(run, PIECES.replace("doc_id", f"`{key}`", 1))
