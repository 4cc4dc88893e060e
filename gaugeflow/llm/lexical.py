"""Ranked lexical search as blocked dense products: item vocabulary tiles times document impact tiles.

The items of a group have a compact vocabulary. One scan keeps, per document, the counts of its terms in that
vocabulary; document frequencies are counted from these. Then blocks of documents become dense tiles of impacts, blocks
of items dense tiles of weights over just their own terms, and BLAS multiplies them in float64. All entries are
integers and a tile is so narrow that no partial sum reaches 2 ** 53, so products are exact; tiles are added as 64-bit
integers. A task keeps k documents per item, ties by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm import terms
from gaugeflow.llm.shared import stored

GROUP_BYTES = 8 << 20
ITEM_TILE = 64
DOC_TILE = 512
TERM_TILE = 4096
EXACT = 1 << 53
TASKS_TOGETHER = 256
MOST_IMPACT = 10**6  # (1000000000 * tf) div (1000 * tf + 20 * m), as m >= 0


def _item_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The vocabulary of some texts, and (text, term) pairs, once each."""
    found = [(np.asarray(of), t) for t, of in terms.pieces(texts, terms.WORD_CHARACTERS)]
    words = pa.chunked_array([t.take(pa.array(np.arange(0, len(t), 2))) for _, t in found], pa.large_binary()).combine_chunks()
    coded = words.dictionary_encode()
    rows = np.concatenate([of for of, _ in found]) if found else np.zeros(0, np.int64)
    (row, term), _ = terms.distinct(rows, coded.indices.to_numpy().astype(np.int64), weights=[])
    return coded.dictionary, row, term


def _counter(vocabulary: pa.Array):
    """Per document with a term: id, number of its terms, and its terms of the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            rows, ids, counts = [], [], []
            for words, row in terms.pieces(batch.column(1), terms.WORD_CHARACTERS):
                n += np.bincount(row, minlength=len(n))
                at = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy()[0::2]
                hit = at >= 0
                (term, of), (count,) = terms.distinct(at[hit], row[hit], weights=[np.ones(int(hit.sum()), np.int64)])
                rows.append(of), ids.append(term), counts.append(count)
            (term, of), (count,) = terms.distinct(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, rows)), weights=[np.concatenate(counts) if counts else np.zeros(0, np.int64)])
            cuts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(n))))).astype(np.int32))
            out = [batch.column(0), pa.array(n), pa.ListArray.from_arrays(cuts, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(count))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    return run


def _lengths(n: np.ndarray, total: int, docs: int) -> np.ndarray:
    """100 - 50 + (50 * n * N) div L, without overflow."""
    if int(n.max(initial=0)) * 50 * docs < 1 << 63:
        return 50 + (50 * n * docs) // total
    return 50 + np.array([50 * x * docs // total for x in n.tolist()], np.int64)


class Tile:
    """Some items: the terms they hold, in columns of bounded width, and their weights."""

    def __init__(self, items: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray):
        used = np.unique(term)
        most = max(1, int(weight[used].max(initial=1)))
        self.items = items
        self.width = max(1, min(TERM_TILE, (EXACT - 1) // (most * MOST_IMPACT)))
        self.place = np.full(len(weight), -1, np.int64)
        self.place[used] = np.arange(len(used))
        self.weights = []
        for first in range(0, len(used), self.width):
            here = (self.place[term] >= first) & (self.place[term] < first + self.width)
            w = np.zeros((min(self.width, len(used) - first), len(items)))
            w[self.place[term[here]] - first, row[here]] = weight[term[here]]
            self.weights.append(w)

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Score of every document (row) for every item (column)."""
        place = self.place[term]
        total = np.zeros((n_docs, len(self.items)), np.int64)
        for k, weights in enumerate(self.weights):
            here = (place >= k * self.width) & (place < (k + 1) * self.width)
            if here.any():
                tile = np.zeros((n_docs, len(weights)))
                tile[doc[here], place[here] - k * self.width] = impact[here]
                total += (tile @ weights).astype(np.int64)
        return total


class Best:
    """The k best documents per item so far: highest scores, then smallest ids, a null id last."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.rows, self.held = k, np.ones(items, np.int64), [], 0

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        doc, column = np.nonzero(scores >= self.least[items])  # ties with the k-th stay in
        self.rows.append((items[column], scores[doc, column], ids[doc], missing[doc]))
        self.held += len(doc)
        if self.held > 4 * self.k * len(self.least) + 100_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, id, missing = (np.concatenate(x) for x in zip(*self.rows)) if self.rows else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((id, missing, -score, item))
        first = np.searchsorted(item[order], np.arange(len(self.least)))
        order = order[np.arange(len(order)) - first[item[order]] < self.k]
        kept = tuple(x[order] for x in (item, score, id, missing))
        counts = np.bincount(kept[0], minlength=len(self.least))
        full = np.flatnonzero(counts == self.k)
        self.least[full] = kept[1][np.cumsum(counts)[full] - 1]
        self.rows, self.held = [kept], len(order)
        return kept


def _multiplier(tiles: list[Tile], items: int, total: int, docs: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k)
        for whole in batches:
            for first in range(0, whole.num_rows, DOC_TILE):
                batch = whole.slice(first, DOC_TILE)
                sizes = pc.list_value_length(batch.column(2)).to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                m = _lengths(batch.column(1).to_numpy(), total, docs)
                impact = (10**9 * tf) // (1000 * tf + 20 * m[doc])
                ids, missing = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
                for tile in tiles:
                    best.add(tile.items, tile.scores(doc, term, impact, batch.num_rows), ids, missing)
        item, score, id, missing = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(id, mask=missing.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _group(docs: DataFrame, items: pa.Table, k: int) -> DataFrame | None:
    """The best documents for a group of items of bounded size."""
    vocabulary, row, term = _item_terms(items.column("text"))
    if not len(vocabulary):
        return None
    counted = stored(docs.mapInArrow(_counter(vocabulary), "doc_id long, n long, terms array<int>, tf array<long>"))
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    # one row per term of the group's vocabulary at most
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[frequency.column("term").to_numpy()] = frequency.column("count").to_numpy()
    n = total["docs"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    tiles = []
    for first in range(0, items.num_rows, ITEM_TILE):
        own = np.arange(first, min(first + ITEM_TILE, items.num_rows))
        here = (row >= first) & (row < first + ITEM_TILE)
        tiles.append(Tile(own, row[here] - first, term[here], weight))
    told = counted.mapInArrow(_multiplier(tiles, items.num_rows, total["terms"], n, k), "item long, doc_id long, score long")
    # two levels, so that no task ranks what all tasks found for an item
    best = lambda *by: F.row_number().over(Window.partitionBy("item", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    told = told.withColumn("some", F.floor(F.spark_partition_id() / TASKS_TOGETHER))
    told = told.withColumn("rank", best("some")).where(F.col("rank") <= k).withColumn("rank", best()).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame(pa.table({"item": np.arange(items.num_rows), "item_id": items.column("item_id")}))
    return told.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, k: int = 50, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for every (item_id, text) of items its k best rows (doc_id, text) of docs.

    A term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))), a document's impact
    (10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L; the score sums their products over the item's terms,
    once each. Only scores above 0 count; ties go to the smaller doc_id, a null id last. Null and empty texts have no
    terms: such documents take no part, such items have no result. Rows of docs with one id are documents of their
    own; equal rows of items are one item, rows of an id with different texts are ranked apart. Texts of any length are
    read whole, a few MB at a time. Empty tables give no rows; other columns are not read.

    Items are dealt into groups of about group_bytes of text; each group's vocabulary and weights go to all tasks and
    each group takes one scan of the texts. What a scan keeps are its terms' counts, written to the shared folder.
    """
    spark = docs.sparkSession
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text").where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    dealt = items.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    parts = []
    for g in range(groups):
        own = dealt.where(F.col("group") == g).select("item_id", "text").toArrow()  # about group_bytes
        if own.num_rows and (found := _group(docs, own, k)) is not None:
            parts.append(found)
    kind = items.schema["item_id"].dataType.simpleString()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
