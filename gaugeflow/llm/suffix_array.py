"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every window of `threshold` bytes is a suffix cut at that depth; equal windows are what a suffix array of all documents
would show as neighbours with that much in common. Sorting all of them would move each text `threshold` times, so the
sort is prepared by three cheaper rounds, each over what the one before left open:

1. Anchors. Of the 26-byte strings inside a window the one with the least hash is its anchor, chosen by the window's
   bytes alone, so equal windows have equal anchors. Only anchors that occur in two documents stay.
2. Surroundings. The bytes around an anchor that any window with this anchor can reach. A document whose anchor has
   the very surroundings that it has in a document with a smaller key loses them whole. What stays open are anchors
   that are the first of their surroundings, if the anchor has others elsewhere.
3. The windows at those anchors. They are sorted by most-significant-digit passes of 8 bytes; a group of one is dropped
   after each pass, and the groups left at the full depth are exactly the repeated windows. The surroundings of one
   anchor hold all its windows in 76 bytes and go to one bucket; an anchor with more than MANY of them (a passage that a
   good part of all documents hold) sends its distinct windows instead, each to the bucket of its own hash.

In all rounds a block of documents sends one entry per distinct key, so a passage that is in a third of all documents is
one entry per block. Hashes of rounds 1 and 2 have 64 bits (40 where they only tell surroundings apart); windows are
compared by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import arrays, blocks

THRESHOLD, ANCHOR = 50, 26
REACH = THRESHOLD - ANCHOR  # a window starts at most this far before its anchor
SPREAD = REACH + 1  # anchors are least among this many neighbours
KEYS, AROUND, OTHERS, WINDOWS, PLACES = 0, 1, 2, 3, 4
MANY = 4096
ANCHORS_AT_ONCE = 1024
WORK_BYTES = 1 << 19
HASHED_AT_ONCE = 1 << 12
NEVER = np.iinfo(np.int64).max  # the key of documents without one: larger than all


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each position on (that many bytes fewer at the end)."""
    power = np.array([0x9E3779B97F4A7C15], np.uint64)
    levels, h, size = {1: (arrays.mixed(np.arange(1, 257, dtype=np.uint64))[data], power)}, None, 1
    while 2 * size <= ANCHOR:
        h, p = levels[size]
        levels[2 * size] = (h[: len(h) - size] * p + h[size:], np.multiply(p, p, dtype=np.uint64))
        size *= 2
    out, done = None, 0
    for size in sorted(levels, reverse=True):
        if done + size <= ANCHOR:
            h, p = levels[size]
            out = h if out is None else out[: len(h) - done] * p + h[done:]
            done += size
    return arrays.mixed(out) | np.uint64(1)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, row) of every anchor of the rows with at least THRESHOLD bytes."""
    found = [[], [], []]
    for a, b in arrays.chunks(offsets, WORK_BYTES):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) < THRESHOLD:
            continue
        h = _rolling(part)
        least, width = h, 1
        while width < SPREAD:
            step = min(width, SPREAD - width)
            least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
        for end in at[1:].tolist():  # a window that starts here crosses the end of its row
            least[max(0, end - THRESHOLD + 1) : end] = 0
        most, width = np.concatenate((np.zeros(SPREAD - 1, np.uint64), least, np.zeros(max(0, len(h) - len(least)), np.uint64))), 1
        while width < SPREAD:
            step = min(width, SPREAD - width)
            most, width = np.maximum(most[: len(most) - step], most[step:]), width + step
        place = np.flatnonzero(most[: len(h)] == h)
        for x, y in zip(found, (place + offsets[a], h[place], np.searchsorted(at, place, "right") - 1 + a)):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(found, (np.int64, np.uint64, np.int64)))


class Block:
    """What a block of documents knows, given the answers so far."""

    def __init__(self, table: pa.Table, told: blocks.Answers, buckets: int):
        self.data, self.offsets = arrays.flat(table.column("text"))
        self.key = table.column("key").fill_null(NEVER).to_numpy()
        self.told, self.buckets = told, buckets
        self.position, self.hash, self.row = anchors(self.data, self.offsets)

    def ask(self, kind: int, ids: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        for bucket, a, b in blocks.dealt(ids, self.buckets):
            yield kind, bucket, blocks.squeezed(blocks.differences(ids[a:b]), *(v[a:b] for v in values))

    def answer(self, kind: int, ids: np.ndarray, each: int = 1, which: int = 0) -> np.ndarray:
        """The answers to ids, one bit of each (of `each` that were told)."""
        parts = [blocks.flags(self.told[kind, bucket], each * (b - a)).reshape(each, -1)[which] for bucket, a, b in blocks.dealt(ids, self.buckets)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def anchor_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, where each anchor is among them, and which are in two documents of this block."""
        own, at = np.unique(self.hash, return_inverse=True)
        low, high = np.full(len(own), NEVER), np.full(len(own), -1)
        np.minimum.at(low, at, self.row)
        np.maximum.at(high, at, self.row)
        return own, at, low != high

    def keep_shared(self) -> None:
        own, at, _ = self.anchor_keys()
        shared = self.answer(KEYS, own)[at]
        self.position, self.hash, self.row = self.position[shared], self.hash[shared], self.row[shared]
        self.first = np.maximum(self.offsets[self.row], self.position - REACH)
        self.last = np.minimum(self.offsets[self.row + 1], self.position + THRESHOLD)
        wide = self.last - self.first >= THRESHOLD
        for name in ("position", "hash", "row", "first", "last"):
            setattr(self, name, getattr(self, name)[wide])
        around = np.zeros(len(self.hash), np.uint64)
        for a in range(0, len(around), HASHED_AT_ONCE):
            b = a + HASHED_AT_ONCE
            around[a:b] = arrays.hashes(self.data, arrays.Spans(self.first[a:b], self.last[a:b], self.row[a:b]))
        # The anchor's place counts: in a run of one byte, equal surroundings may hold it at different places.
        self.around = arrays.mixed(around + self.hash + (self.position - self.first).astype(np.uint64) * arrays.MULTIPLIER)

    def surroundings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (anchor, surroundings), where each anchor is among them, and the least document key of each."""
        own, at = np.unique(self.around, return_inverse=True)
        least = np.full(len(own), NEVER)
        np.minimum.at(least, at, self.key[self.row])
        return own, at, least

    def others(self) -> tuple[np.ndarray, ...]:
        """Distinct anchors, where each is, the least and greatest (40 bits) of its surroundings, and how often it is here."""
        own, at = np.unique(self.hash, return_inverse=True)
        low, high = np.full(len(own), ~np.uint64(0)), np.zeros(len(own), np.uint64)
        around = self.around >> np.uint64(24)
        np.minimum.at(low, at, around)
        np.maximum.at(high, at, around)
        return own, at, low, high, np.minimum(np.bincount(at, minlength=len(own)), 65535).astype(np.uint16)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which anchors lose their surroundings whole; which are open: first of theirs, with others elsewhere; which of those are MANY."""
        own, at, least = self.surroundings()
        whole = self.answer(AROUND, own)[at] | (self.key[self.row] > least[at])
        names, place, *_ = self.others()
        several, many = (self.answer(OTHERS, names, 2, i)[place] for i in (0, 1))
        return whole, ~whole & several & ~many, ~whole & several & many

    def places(self, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the open anchors: one of each distinct (anchor, surroundings), ascending by anchor, and which of those each open one is."""
        at = np.flatnonzero(open_)
        _, one, which = np.unique(self.around[at], return_index=True, return_inverse=True)
        order = np.argsort(self.hash[at[one]], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return at[one[order]], place[which]

    def windows(self, open_: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts and rows of the windows at open anchors; their distinct hashes, where each window is among them, the least key and one start of each."""
        mark = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(mark, self.first[open_], 1)
        np.add.at(mark, self.last[open_] - THRESHOLD + 1, -1)
        start = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int32) > 0)
        row = np.searchsorted(self.offsets, start, "right") - 1
        hashed = np.zeros(len(start), np.uint64)
        for a in range(0, len(start), HASHED_AT_ONCE):
            b = a + HASHED_AT_ONCE
            hashed[a:b] = arrays.hashes(self.data, arrays.Spans(start[a:b], start[a:b] + THRESHOLD, row[a:b]))
        own, one, at = np.unique(hashed, return_index=True, return_inverse=True)
        least = np.full(len(own), NEVER)
        np.minimum.at(least, at, self.key[row])
        return start, row, own, at, least, start[one]


def _ask_keys(buckets: int):
    def run(table: pa.Table, told: blocks.Answers) -> Iterator[tuple[int, int, bytes]]:
        block = Block(table, told, buckets)
        own, _, twice = block.anchor_keys()
        yield from block.ask(KEYS, own, twice.astype(np.uint8))

    return run


def _ask_around(buckets: int):
    def run(table: pa.Table, told: blocks.Answers) -> Iterator[tuple[int, int, bytes]]:
        block = Block(table, told, buckets)
        block.keep_shared()
        own, _, least = block.surroundings()
        yield from block.ask(AROUND, own, least)
        own, _, low, high, count = block.others()
        yield from block.ask(OTHERS, own, low, low ^ high, count)

    return run


def _ask_windows(buckets: int):
    def run(table: pa.Table, told: blocks.Answers) -> Iterator[tuple[int, int, bytes]]:
        block = Block(table, told, buckets)
        block.keep_shared()
        _, open_, many = block.settle()
        one, _ = block.places(open_)
        for bucket, a, b in blocks.dealt(block.hash[one], buckets):
            some = one[a:b]
            ahead, length = (block.position[some] - block.first[some]).astype(np.uint8), (block.last[some] - block.first[some]).astype(np.uint8)
            text = b"".join(block.data[x:y].tobytes() for x, y in zip(block.first[some].tolist(), block.last[some].tolist()))
            head = blocks.squeezed(blocks.differences(block.hash[some]), block.key[block.row[some]], ahead, length)
            yield PLACES, bucket, np.int64(len(head)).tobytes() + head + zstandard.compress(text, 1)
        _, _, own, _, least, at = block.windows(many)
        for bucket, a, b in blocks.dealt(own, buckets):
            text = block.data[at[a:b, None] + np.arange(THRESHOLD)]
            yield WINDOWS, bucket, zstandard.compress(np.int64(b - a).tobytes() + least[a:b].tobytes() + text.tobytes(), 1)

    return run


def radix_groups(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal bytes: (rows in the order of their windows, group number of each), groups of one left out.

    Most significant digit first, 8 bytes a pass; what is alone in its group after a pass needs no further one.
    """
    n, depth = windows.shape
    padded = np.zeros((n, -(-depth // 8) * 8), np.uint8)
    padded[:, :depth] = windows
    digits = padded.view(">u8").astype(np.uint64)
    rows, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(digits.shape[1]):
        digit = digits[rows, d]
        order = np.lexsort((digit, group))
        rows, group, digit = rows[order], group[order], digit[order]
        new = np.ones(len(rows), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        rows, group = rows[several], group[several]
    return rows, group


def _least_of_groups(windows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window, whether an equal one has a smaller document."""
    rows, group = radix_groups(windows)
    told = np.zeros(len(least), bool)
    if len(rows):
        best = np.full(int(group.max()) + 1, NEVER)
        np.minimum.at(best, group, least[rows])
        told[rows] = best[group] < least[rows]
    return told


def _answer_places(payloads: list[bytes]) -> list[bytes]:
    """For each anchor with its surroundings the windows that a smaller document has too: bit r for the one that starts r bytes before the anchor."""
    heads, texts = [], []
    for p in payloads:
        size = int(np.frombuffer(p[:8], np.int64)[0])
        heads.append(blocks.restored(p[8 : 8 + size], "u8", "i8", "u1", "u1"))
        texts.append(zstandard.decompress(p[8 + size :]))
    sizes = [len(h[0]) for h in heads]
    name = np.concatenate([np.cumsum(h[0], dtype=np.uint64) for h in heads])
    key, ahead, length = (np.concatenate(x) for x in list(zip(*heads))[1:])
    ahead, length = ahead.astype(np.int64), length.astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(length) - length
    order = np.argsort(name, kind="stable")
    masks = np.zeros(len(name), np.uint32)
    cuts = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))  # an anchor's surroundings stay together
    some = np.concatenate((cuts[np.unique(np.searchsorted(cuts, np.arange(0, len(name), ANCHORS_AT_ONCE), "right") - 1)], [len(name)]))
    for a, b in zip(some[:-1], some[1:]):
        part = order[a:b]
        each = length[part] - THRESHOLD + 1
        entry = np.repeat(part, each)
        shift = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        windows = data[(begin[entry] + shift)[:, None] + np.arange(THRESHOLD)]
        gone = _least_of_groups(windows, key[entry])
        np.bitwise_or.at(masks, entry[gone], np.uint32(1) << (ahead[entry] - shift)[gone].astype(np.uint32))
    cut = np.cumsum([0, *sizes])
    return [blocks.squeezed(masks[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _answer(kind: int, payloads: list[bytes]) -> list[bytes]:
    """Per entry of each block: the anchor is in two documents; a smaller document has it too; there are other surroundings, and MANY."""
    if kind == PLACES:
        return _answer_places(payloads)
    if kind == WINDOWS:
        opened = [zstandard.decompress(p) for p in payloads]
        sizes = [int(np.frombuffer(p[:8], np.int64)[0]) for p in opened]
        least = np.concatenate([np.frombuffer(p, np.int64, n, 8) for p, n in zip(opened, sizes)])
        text = np.concatenate([np.frombuffer(p, np.uint8, n * THRESHOLD, 8 + 8 * n).reshape(n, THRESHOLD) for p, n in zip(opened, sizes)])
        told = _least_of_groups(text, least)
    else:
        kinds = {KEYS: ("u8", "u1"), AROUND: ("u8", "i8"), OTHERS: ("u8", "u8", "u8", "u2")}[kind]
        parts = [blocks.restored(p, *kinds) for p in payloads]
        sizes = [len(p[0]) for p in parts]
        own, at = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
        values = [np.concatenate(x) for x in list(zip(*parts))[1:]]
        if kind == KEYS:
            told = (np.bincount(at, weights=1 + values[0].astype(np.int64), minlength=len(own)) > 1)[at]
        elif kind == AROUND:
            best = np.full(len(own), NEVER)
            np.minimum.at(best, at, values[0])
            told = best[at] < values[0]
        else:
            low, high = np.full(len(own), ~np.uint64(0)), np.zeros(len(own), np.uint64)
            np.minimum.at(low, at, values[0])
            np.maximum.at(high, at, values[0] ^ values[1])
            several, many = (low != high)[at], (np.bincount(at, weights=values[2]) > MANY)[at]
            cut = np.cumsum([0, *sizes])
            return [blocks.bits(np.concatenate((several[a:b], many[a:b]))) for a, b in zip(cut[:-1], cut[1:])]
    cut = np.cumsum([0, *sizes])
    return [blocks.bits(told[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _remove(buckets: int, as_text: bool):
    def run(table: pa.Table, told: blocks.Answers) -> pa.Table:
        block = Block(table, told, buckets)
        block.keep_shared()
        whole, open_, many = block.settle()
        start, row, own, at, least, _ = block.windows(many)
        gone = (block.answer(WINDOWS, own)[at] | (block.key[row] > least[at])) if len(own) else np.zeros(0, bool)
        mark = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(mark, np.concatenate((block.first[whole], start[gone])), 1)
        np.add.at(mark, np.concatenate((block.last[whole], start[gone] + THRESHOLD)), -1)
        one, which = block.places(open_)
        if len(one):
            masks = np.concatenate([blocks.restored(told[PLACES, bucket], "u4")[0] for bucket, _, _ in blocks.dealt(block.hash[one], buckets)])[which]
            position = block.position[open_]
            for r in range(SPREAD):
                start = position[(masks >> np.uint32(r)) & np.uint32(1) == 1] - r
                np.add.at(mark, start, 1)
                np.add.at(mark, start + THRESHOLD, -1)
        removed = np.cumsum(mark[:-1], dtype=np.int32) > 0
        spans = arrays.runs(removed, block.offsets)
        rows = table.num_rows
        per_row = np.concatenate(([0], np.cumsum(np.bincount(spans.doc, minlength=rows)))).astype(np.int32)
        begin = block.offsets[spans.doc]
        pairs = pa.StructArray.from_arrays([pa.array(spans.start - begin), pa.array(spans.end - begin)], ["start", "end"])
        kept = block.data[~removed]
        total = np.concatenate(([0], np.cumsum(~removed, dtype=np.int32)))
        offsets = total[block.offsets]
        if as_text:
            texts = pa.array([kept[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
        else:
            texts = pa.array([kept[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
        names = [c for c in table.column_names if c not in ("key", "text")]
        columns = [*(table.column(c) for c in names), pa.array(np.diff(block.offsets)), pa.ListArray.from_arrays(pa.array(per_row), pairs), texts]
        return pa.table(columns, [*names, "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("*",), as_text: bool = False, block_bytes: int = blocks.BLOCK_BYTES // 2) -> DataFrame:
    """Every document: `row` (a struct of the columns named in carry; by default all but the text), `n_bytes`, `spans` removed (byte ranges), `kept`.

    A byte goes if a THRESHOLD-byte string that covers it also starts in a document with a smaller key; strings never
    cross documents and are judged on the input. `kept` holds the other bytes; as_text makes it a string, without the
    characters that a removed span cuts. Keys are integers; a null key is larger than all others, so its document loses
    what others have and takes from none. Rows with equal keys take nothing from each other. Null and empty texts have no
    bytes and lose none. Texts of any length are read whole; empty input gives no rows; other columns stay in `row`.
    The packed blocks stay persisted for the result, until blocks.release(spark).
    """
    carry = tuple(c for c in docs.columns if c != text) if carry == ("*",) else carry
    columns = [F.struct(*carry).alias("row"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    packed = blocks.packed(docs, columns, block_bytes, StorageLevel.DISK_ONLY)
    buckets = blocks.bucket_count(packed)
    one = blocks.answered(blocks.asked(packed, _ask_keys(buckets)), _answer)
    two = one.unionByName(blocks.answered(blocks.asked(packed, _ask_around(buckets), one), _answer))
    three = two.unionByName(blocks.answered(blocks.asked(packed, _ask_windows(buckets), two), _answer))
    row = docs.select(F.struct(*carry).alias("row")).schema[0].dataType.simpleString()
    schema = f"row {row}, n_bytes long, spans array<struct<start: long, end: long>>, kept {'string' if as_text else 'binary'}"
    return blocks.finished(packed, _remove(buckets, as_text), schema, three)
