"""Exact top-k by inner product with vector-approximation files.

Vectors are dealt into blocks. A block's approximation file keeps, per dimension, the number of the cell that holds the
component; cells have about equal counts and know their least and greatest value. For a query, a scan of the cells
gives bounds of every score. Exact vectors are read in the order of their best possible score until no unread vector
can reach the k-th exact one. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 16
TILE = 128
READ_AT_ONCE = 32
LAST_ID = np.iinfo(np.int64).max


class ApproximationFile:
    """Cells of every vector of a block, and the exact vectors they stand for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cells: int = CELLS):
        self.ids, self.vectors = ids, vectors
        n, d = vectors.shape
        self.cell = np.zeros((n, d), np.uint8)
        self.low, self.high = np.zeros((d, cells)), np.zeros((d, cells))
        for j in range(d):
            column = vectors[:, j]
            cuts = np.unique(np.quantile(column, np.arange(1, cells) / cells, method="higher"))
            own = np.searchsorted(cuts, column, "right")
            self.cell[:, j] = own
            for c in np.unique(own):
                inside = column[own == c]
                self.low[j, c], self.high[j, c] = inside.min(), inside.max()

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, row, score): the k best rows of the block for each query, all if fewer."""
        at = np.arange(self.cell.shape[1])[None, :]
        low, high = self.low[at, self.cell].T, self.high[at, self.cell].T
        out = [[], [], []]
        for first in range(0, len(queries), TILE):
            q = queries[first : first + TILE].astype(np.float64)
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            slack = 1e-9 + 1e-12 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)))  # float64 rounding, if components are huge
            most, least = up @ high + down @ low + slack, up @ low + down @ high - slack
            own = self.ids[None, :] == query_ids[first : first + TILE, None]
            most[own], least[own] = -np.inf, -np.inf
            kth = np.partition(least, -k, axis=1)[:, -k] if least.shape[1] > k else np.full(len(q), -np.inf)
            for i in range(len(q)):
                rows = np.flatnonzero((most[i] >= kth[i]) & ~own[i])
                rows = rows[np.argsort(-most[i][rows], kind="stable")]
                best_row, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for a in range(0, len(rows), READ_AT_ONCE):
                    if len(best) == k and most[i][rows[a]] < best[-1]:
                        break
                    some = rows[a : a + READ_AT_ONCE]
                    best_row, best = np.concatenate((best_row, some)), np.concatenate((best, self.vectors[some] @ queries[first + i]))
                    order = np.lexsort((self.ids[best_row], -best))[:k]
                    best_row, best = best_row[order], best[order]
                for x, y in zip(out, (np.full(len(best), first + i), best_row, best)):
                    x.append(y)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.int64, copy=False)


def _search(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        ids = vectors.column("id").fill_null(LAST_ID).to_numpy()
        query_ids = queries.column("id").to_numpy()
        q, row, score = ApproximationFile(ids, _matrix(vectors, "vector")).search(query_ids, _matrix(queries, "vector"), k)
        return pa.table([pa.array(query_ids[q]), vectors.column("id").combine_chunks().take(pa.array(row)), pa.array(score)], schema=schema)

    return run


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, vector_block: int = 2048, query_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row (id, vector) of queries its k best rows (id, vector) of vectors.

    Vectors are arrays of long; the score is their inner product, which must fit a long. Rows with the query's own id
    are not its results, nor are vectors of another length. Ties go to the smaller id, a null id last. Queries are
    taken once per id (of several vectors the least); rows without a vector, and queries without an id, take no part.
    With fewer than k others all are returned; no queries or no vectors give no rows.

    Work is a grid of cells, one block of queries against one block of vectors; each side is copied once per block of
    the other, and a cell holds vector_block + query_block vectors whatever the input's size.
    """
    vectors = vectors.where("vector IS NOT NULL").select("id", "vector")
    queries = queries.where("vector IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector"))
    v_blocks, q_blocks = max(1, -(-vectors.count() // vector_block)), max(1, -(-queries.count() // query_block))
    place = lambda blocks: F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select("id", "vector", F.size("vector").alias("d"), place(q_blocks).alias("q"), every(v_blocks).alias("v"))
    right = vectors.select("id", "vector", F.size("vector").alias("d"), place(v_blocks).alias("v"), every(q_blocks).alias("q"))
    cells = left.groupBy("d", "q", "v").cogroup(right.groupBy("d", "q", "v")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
