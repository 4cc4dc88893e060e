"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints within `max_bits` differing bits of each other are linked. Two such fingerprints agree in at least
BLOCKS - max_bits of BLOCKS equal blocks of bits, so each distinct fingerprint is dealt once per choice of agreeing
blocks, to the others with the same bits there. Within such a bucket, fingerprints are sorted by their rank in the Gray
code; neighbours share most bits, and a tree over runs of neighbours keeps the bits that all below share in its upper
nodes. A query descends with the differences counted so far and leaves out every node where they exceed max_bits.
A bucket returns one edge per fingerprint (to the first of its component in the bucket), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import arrays
from gaugeflow.llm.shared import stored

SEED = 42
FANOUT = 16
ROOTS = 32
QUERIES_AT_ONCE = 512


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes (none empty), the bits set in over half of it."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _of_texts(texts: pa.Array, shingle: int) -> np.ndarray:
    data, offsets = arrays.flat(texts)
    out = np.zeros(len(offsets) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b in arrays.chunks(offsets):
        found, sizes, rows = [], [], []
        for i in range(a, b):
            words = data[offsets[i] : offsets[i + 1]].tobytes().lower().split()  # bytes: A-Z and ASCII white space only
            if not words:
                continue
            joined = b" ".join(words)
            end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            start = np.concatenate(([0], end[:-1] + 1))
            k = min(shingle, len(words))
            found += [digest(joined[s:e], SEED) for s, e in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())]
            sizes.append(len(words) - k + 1)
            rows.append(i)
        if rows:
            out[rows] = _majority(np.array(found, np.uint64), np.array(sizes))
    return out.view(np.int64)


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The 64-bit SimHash of a text as a long (its bits; the sign has no meaning), over the XXH64 (seed 42) of its word shingles.

    Words are runs without ASCII white space, A-Z in lower case; repeated shingles count each. A text with fewer words
    than a shingle has one shingle, all its words; a null text or one without words has fingerprint 0.
    """

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(_of_texts(texts, shingle))

    return run(text)


def gray_rank(code: Column) -> Column:
    """The position of a 64-bit word in the reflected Gray code, as a long that sorts like it."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def bucket_keys(code: Column, max_bits: int) -> Column:
    """One key per choice of blocks that two fingerprints within max_bits must share one of."""
    blocks = 2 * max_bits if max_bits else 1
    width = 64 // blocks
    edges = [(i * width, 64 if i == blocks - 1 else (i + 1) * width) for i in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(edges, blocks - max_bits if max_bits else 1)):
        mask = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.struct(F.lit(n).cast("byte").alias("choice"), code.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


class GrayIndex:
    """A tree over fingerprints in Gray order. Level 0 holds runs of FANOUT fingerprints, the last level at most ROOTS nodes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.masks, self.values = [], []  # by level: the bits that all below share and that no node above already has
        shared, value, levels = np.full(len(codes), ~np.uint64(0)), codes, []
        while len(value) > ROOTS or not levels:
            starts = np.arange(0, len(value), FANOUT)
            low, high = np.bitwise_and.reduceat(value, starts), np.bitwise_or.reduceat(value, starts)
            shared = np.bitwise_and.reduceat(shared, starts) & ~(low ^ high)
            value = low & shared
            levels.append((shared, value))
        for k, (mask, value) in enumerate(levels):
            above = np.repeat(levels[k + 1][0], FANOUT)[: len(mask)] if k + 1 < len(levels) else np.zeros(len(mask), np.uint64)
            self.masks.append(mask & ~above)
            self.values.append(value)

    def within(self, first: int, last: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) of positions, first <= i < last, i < j, that differ in at most `most` bits."""
        roots = len(self.masks[-1])
        query, node = np.repeat(np.arange(first, last), roots), np.tile(np.arange(roots), last - first)
        so_far = np.zeros(len(query), np.uint8)
        for level in range(len(self.masks) - 1, -1, -1):
            span = FANOUT ** (level + 1)
            so_far = so_far + np.bitwise_count((self.codes[query] ^ self.values[level][node]) & self.masks[level][node])
            near = (so_far <= most) & ((node + 1) * span > query + 1)
            query, node, so_far = query[near], node[near], so_far[near]
            size = len(self.masks[level - 1]) if level else len(self.codes)
            child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            query, so_far = np.repeat(query, FANOUT), np.repeat(so_far, FANOUT)
            real = child < size
            query, node, so_far = query[real], child[real], so_far[real]
        near = (np.bitwise_count(self.codes[query] ^ self.codes[node]) <= most) & (node > query)
        return query[near], node[near]


def _components(codes: np.ndarray, most: int) -> np.ndarray:
    """For each fingerprint the first position of its component."""
    index, label = GrayIndex(codes), np.arange(len(codes))
    for first in range(0, len(codes), QUERIES_AT_ONCE):
        i, j = index.within(first, min(len(codes), first + QUERIES_AT_ONCE), most)
        # Every label is a root here. Only roots are hooked, so ties of earlier batches hold; a pair is done once its roots are one.
        while (apart := label[i] != label[j]).any():
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
            while (label != (above := label[label])).any():
                label = above
    return label


def _edges(most: int):
    """(bits, choice, code) sorted by bucket and Gray rank, to edges (code, linked); one bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []

        def close() -> Iterator[pa.RecordBatch]:
            choice, bits, code = (np.concatenate(x) for x in zip(*kept))
            kept.clear()
            cuts = np.concatenate(([0], np.flatnonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])) + 1, [len(code)]))
            left, right = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > 1:
                    label = _components(code[a:b], most)
                    own = np.flatnonzero(label != np.arange(b - a))
                    left.append(code[a:b][own])
                    right.append(code[a:b][label[own]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            choice, bits, code = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            cut = int(np.flatnonzero((choice != choice[-1]) | (bits != bits[-1]))[-1]) + 1 if (choice[0] != choice[-1] or bits[0] != bits[-1]) else 0
            if kept and (cut or kept[-1][0][-1] != choice[0] or kept[-1][1][-1] != bits[0]):
                if cut:
                    kept.append([choice[:cut], bits[:cut], code[:cut]])
                yield from close()
            elif cut:
                kept.append([choice[:cut], bits[:cut], code[:cut]])
                yield from close()
            kept.append([choice[cut:], bits[cut:], code[cut:]])
        if kept:
            yield from close()

    return run


def links(codes: DataFrame, *, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct values of column `code` that chains of max_bits or fewer differing bits connect."""
    dealt = codes.select("code", F.explode(bucket_keys(F.col("code"), max_bits)).alias("k")).select("k.choice", "k.bits", "code")
    dealt = dealt.repartition("choice", "bits").sortWithinPartitions("choice", "bits", gray_rank(F.col("code")))
    return dealt.mapInArrow(_edges(max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) connect each of their nodes with; nodes without an edge are absent.

    Alternating large-star and small-star steps. Each step's minima are a table, so that the join on a node with very
    many neighbours is one that Spark can split; each step's edges are a table too.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(large.where("a != b").distinct())
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m")))
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2, carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """Every document: `row` (a struct of the columns named in carry), `code` (its fingerprint), `root`, `component`.

    Documents whose fingerprints differ in at most max_bits bits are linked; `component` is the smallest key reachable,
    the document's own included, and `root` a fingerprint that its component shares. Fingerprint 0 (no words) links like
    any other. Null keys are never the smallest: a component of null keys only has a null component. Repeated rows are
    rows of one component. Empty input gives no rows; other columns stay in `row`.
    """
    # written once: the fingerprint is the dearest part and both what links and what is linked need it
    hashed = stored(docs.select(F.struct(*carry).alias("row"), F.col(key).alias("key"), fingerprint(F.col(text), shingle).alias("code")))
    ids = hashed.select("key", "code")
    codes = stored(ids.groupBy("code").agg(F.min("key").alias("least")))
    roots = stored(components(links(codes, max_bits=max_bits)))
    told = stored(codes.join(roots.withColumnRenamed("node", "code"), "code", "left").select("code", "least", F.coalesce("root", "code").alias("root")))
    smallest = stored(told.groupBy("root").agg(F.min("least").alias("component")))
    told = stored(told.join(smallest, "root").select("code", "root", "component"))
    return hashed.join(told, "code").select("row", "code", "root", "component")
