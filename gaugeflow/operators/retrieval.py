"""Nearest chunks by cosine, and the texts built from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.model import RETRIEVAL_DEPTH

# Bytes of query vectors that may be sent to every task; more queries meet the vectors in a grid.
BROADCAST_BYTES = 32 << 20
# Bytes of scores a task holds at a time at most, and of vectors that are multiplied at a time.
TILE_BYTES = 64 << 20
BLOCK_BYTES = 64 << 20
# Bytes of queries, and of vectors, that one cell of the grid holds.
CELL_BYTES = 64 << 20
# Pairs that are worth a task of their own; queries that are worth moving the vectors for; vectors that a task with very
# many queries must have, for the scores to cost more than keeping k of them per query.
TASK_PAIRS = 1 << 26
MANY_QUERIES, MANY_VECTORS = 256, 1 << 13
# Bytes of copied vectors a task hands on at a time.
COPIED_BYTES = 4 << 20
# A tile of scores that stays in a core's cache; pairs that are scored exactly, and merged, at a time.
CACHED_BYTES, EXACT_PAIRS, MERGED_PAIRS = 1 << 20, 1 << 13, 1 << 18


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows of one matrix."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    widths, numbers = pc.list_value_length(lists).unique(), lists.flatten()
    if lists.null_count or numbers.null_count or len(widths) > 1:
        raise ValueError("embeddings must have one length and no nulls")
    return numbers.to_numpy(zero_copy_only=False).reshape(len(lists), widths[0].as_py() if len(widths) else 0)


class _Units:
    """Rows scaled to length one: in single precision all of them, in double precision those asked for."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.lengths = matrix, np.ones(len(matrix))
        self.rough = np.empty(matrix.shape, "float32")
        for a in range(0, len(matrix), EXACT_PAIRS):
            some = slice(a, a + EXACT_PAIRS)
            length = np.linalg.norm(matrix[some].astype("float64"), axis=1)
            self.lengths[some] = np.where(length == 0, 1.0, length)
            self.rough[some] = self.exact(some)

    def exact(self, at) -> np.ndarray:
        return self.matrix[at].astype("float64") / self.lengths[at][:, None]


def _unit(vectors: pa.Array) -> np.ndarray:
    return _Units(_matrix(vectors)).exact(slice(None))


def _lowest(matrix: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the k best of a query: of equal vectors those with the k lowest ids."""
    if not matrix.size:
        return np.arange(len(matrix))
    whole = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.itemsize * matrix.shape[1]))).ravel()
    group = np.unique(whole, return_inverse=True)[1]
    order = np.lexsort((ids, group))
    first = np.searchsorted(group[order], group[order])
    return np.sort(order[np.arange(len(order)) - first < k])


def _false(flags: np.ndarray) -> np.ndarray:
    """Places of the few that are false; of many flags eight are looked at together."""
    flags = flags.ravel()
    if len(flags) < 1 << 15:
        return np.flatnonzero(~flags)
    whole = len(flags) // 8 * 8
    some = np.flatnonzero(flags[:whole].view("uint64") != 0x0101010101010101)
    places = np.concatenate([(some[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(flags))])
    return places[~flags[places]]


class _Best:
    """Per query the k highest scores so far and their ids; equal scores go to the lower id.

    Products in single precision tell which pairs may reach a query's k-th score; those, a few per query, are scored in
    double precision. A product of unit rows is off by less than half of ``slack``, so none is missed.
    """

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k = _Units(asked), k
        self.scores, self.ids = np.full((len(asked), k), -np.inf), None
        self.floor = np.full(len(asked), -np.inf, "float32")  # products below it are of pairs below the k-th score
        self.slack = (asked.shape[1] + 8) * 2.0**-23

    def meet(self, matrix: np.ndarray, ids: np.ndarray, tile_bytes: int = TILE_BYTES, block_rows: int | None = None) -> None:
        kept = _lowest(matrix, ids, self.k)
        if len(kept) < len(matrix):
            matrix, ids = matrix[kept], ids[kept]
        if not len(ids) or not len(self.floor):
            return
        if self.ids is None:
            self.ids = np.full(self.scores.shape, ids[0], ids.dtype)
        rows, scores = _Units(matrix), max(1, min(tile_bytes, CACHED_BYTES) // 4)
        width = min(len(ids), block_rows or len(ids), max(1, math.isqrt(scores)))
        height = max(1, scores // width)
        found, waiting = [], 0
        for left in range(0, len(ids), width):
            across = rows.rough[left : left + width].T
            for top in range(0, len(self.floor), height):
                near = self.asked.rough[top : top + height] @ across
                floor = self.floor[top : top + height]
                if left == 0 and near.shape[1] >= self.k:
                    np.fmax(floor, np.partition(near, near.shape[1] - self.k, axis=1)[:, -self.k] - 2 * self.slack, out=floor)
                hits = _false(near < floor[:, None])  # NaN, too, may be among the best
                if len(hits):
                    found.append((top, left, near.shape[1], hits))
                    waiting += len(hits)
                if waiting >= MERGED_PAIRS:
                    self._merge(rows, ids, found)
                    found, waiting = [], 0
        if found:
            self._merge(rows, ids, found)

    def _merge(self, rows: _Units, ids: np.ndarray, found: list[tuple[int, int, int, np.ndarray]]) -> None:
        top, left, width, hits = zip(*found)
        top, left, width = (np.repeat(np.array(at), [len(h) for h in hits]) for at in (top, left, width))
        query, row = np.divmod(np.concatenate(hits), width)
        query, row = query + top, row + left
        score = np.empty(len(query))
        for a in range(0, len(query), EXACT_PAIRS):
            some = slice(a, a + EXACT_PAIRS)
            score[some] = np.einsum("ij,ij->i", self.asked.exact(query[some]), rows.exact(row[some]))
        at, own = np.unique(query, return_inverse=True)
        group = np.concatenate([np.repeat(np.arange(len(at)), self.k), own])
        scores = np.concatenate([self.scores[at].ravel(), score])
        names = np.concatenate([self.ids[at].ravel(), ids[row]])
        height = np.where(np.isnan(scores), np.inf, scores)  # as Spark sorts them
        order = np.lexsort((names, -height, group))
        pick = order[np.searchsorted(group[order], np.arange(len(at)))[:, None] + np.arange(self.k)]
        self.scores[at], self.ids[at] = scores[pick], names[pick]
        self.floor[at] = np.fmax(self.floor[at], height[pick[:, -1]] - self.slack)

    def told(self, names: pa.Array | pa.ChunkedArray, kind: pa.DataType) -> pa.Table:
        """query_id, vec_id, score of what was found."""
        query, place = np.nonzero(self.scores != -np.inf)
        ids = np.empty(0) if self.ids is None else self.ids[query, place]
        return pa.table({"query_id": names.take(pa.array(query)), "vec_id": pa.array(ids, kind), "score": pa.array(self.scores[query, place])})


def _numbers(df: DataFrame, embedding: str) -> Column:
    single = df.schema[embedding].dataType.simpleString() == "array<float>"
    return (F.col(embedding) if single else F.col(embedding).cast("array<double>")).alias("embedding")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = RETRIEVAL_DEPTH,
    vec_id: str = "vec_id",
    query_id: str = "query_id",
    embedding: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    tile_bytes: int = TILE_BYTES,
    cell_bytes: int = CELL_BYTES,
    task_pairs: int = TASK_PAIRS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors nearest to each query, exact.

    Queries of up to ``broadcast_bytes`` travel to every task, which multiplies them with its
    vectors and keeps k per query. More queries, or many on few vectors, meet the vectors in a grid
    of hashed cells of at most ``cell_bytes`` of each. Either way the work goes to all cores as long
    as a task is left with ``task_pairs``. Vectors are multiplied in blocks of ``block_bytes`` and
    scores are made in tiles of ``tile_bytes`` at most. Only k rows per query and cell, or task, leave
    it; pairs are never rows. The work is queries x vectors.
    """
    vectors = vectors.select(F.col(vec_id).alias("vec_id"), _numbers(vectors, embedding))
    queries = queries.select(F.col(query_id).alias("query_id"), _numbers(queries, embedding))
    ids = vectors.schema["vec_id"].dataType, queries.schema["query_id"].dataType
    schema = T.StructType(
        [T.StructField("query_id", ids[1]), T.StructField("vec_id", ids[0]), T.StructField("score", T.DoubleType())]
    )
    size = queries.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("width")).first()
    each, asked_rows, rows = 8 * max(1, size["width"]), size["rows"], vectors.count()
    cores, tasks = vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(asked_rows * rows / task_pairs)
    parts = 1 if asked_rows < MANY_QUERIES else min(2 * cores, tasks)  # with few queries the scan's own tasks do
    block_rows = max(1, block_bytes // each)
    if asked_rows * each <= broadcast_bytes and (parts <= 1 or rows >= parts * MANY_VECTORS):
        found = _against_all(vectors, queries, k, schema, parts, block_rows, tile_bytes)
    else:
        side, cell_rows = math.ceil(math.sqrt(min(8 * cores, tasks))), max(1, cell_bytes // each)
        down, across = (max(1, side, math.ceil(n / cell_rows)) for n in (rows, asked_rows))
        found = _in_grid(vectors, queries, k, schema, down, across, block_rows, tile_bytes)
    nearest = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _against_all(vectors: DataFrame, queries: DataFrame, k: int, schema: T.StructType, parts: int, block_rows: int, tile_bytes: int) -> DataFrame:
    rows = queries.toArrow()
    held = vectors.sparkSession.sparkContext.broadcast((rows["query_id"].combine_chunks(), _matrix(rows["embedding"])))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = held.value
        best = None
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            best = best or _Best(asked, k)
            best.meet(_matrix(batch["embedding"]), batch["vec_id"].to_numpy(zero_copy_only=False), tile_bytes, block_rows)
        if best:
            yield from best.told(names, batch["vec_id"].type).to_batches(EXACT_PAIRS)

    return (vectors.repartition(parts) if parts > 1 else vectors).mapInArrow(search, schema)


def _cells(k: int, block_rows: int | None, tile_bytes: int):
    """What the queries and the vectors of one cell have in common."""

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        best = _Best(_matrix(asked["embedding"]), k)
        if block.num_rows:
            best.meet(_matrix(block["embedding"]), block["vec_id"].to_numpy(), tile_bytes, block_rows)
        told = best.told(asked["query_id"], block.schema.field("vec_id").type)
        pa.default_memory_pool().release_unused()
        return told

    return search


def _in_grid(vectors: DataFrame, queries: DataFrame, k: int, schema: T.StructType, down: int, across: int, block_rows: int, tile_bytes: int) -> DataFrame:
    left = vectors.select(
        "*",
        F.pmod(F.xxhash64("vec_id"), F.lit(down)).alias("vector_block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))).alias("query_block"),
    )
    right = queries.select(
        "*",
        F.pmod(F.xxhash64("query_id"), F.lit(across)).alias("query_block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint"))).alias("vector_block"),
    )
    grid = ["query_block", "vector_block"]
    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(_cells(k, block_rows, tile_bytes), schema)


def _slices(batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows(width of their vectors)``."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, rows(max(1, len(batch.column(1)[0]))))
            yield from (batch.slice(a, step) for a in range(0, batch.num_rows, step))


def _signed(planes: np.ndarray, free: int | None):
    """Rows (id, embedding, table, key): the bucket of a vector in every table; with ``free``, the 2 ** free buckets that
    differ from it in the bits whose planes the vector is nearest to. Copies leave COPIED_BYTES at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, bits, _ = planes.shape
        copies = tables * (1 if free is None else 1 << free)
        for batch in _slices(batches, lambda width: COPIED_BYTES // (8 * width * copies)):
            rows = _unit(batch.column(1))
            far = np.einsum("nd,tbd->ntb", rows, planes)
            keys = ((far > 0) << np.arange(bits)).sum(axis=2)[:, :, None]
            if free is not None:
                near = np.argsort(np.abs(far), axis=2, kind="stable")[:, :, :free]
                flips = (np.arange(1 << free)[:, None] >> np.arange(free)) & 1
                keys = keys ^ ((1 << near)[:, :, None, :] * flips).sum(axis=3)
            n, _, probes = keys.shape
            at = pa.array(np.repeat(np.arange(n), tables * probes))
            table = np.tile(np.repeat(np.arange(tables), probes), n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(table.astype(np.int32)), pa.array(keys.ravel().astype(np.int64))], ["id", "embedding", "table", "key"])

    return run


def near_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = RETRIEVAL_DEPTH,
    vec_id: str = "vec_id",
    query_id: str = "query_id",
    embedding: str = "embedding",
    bits: int = 6,
    free: int = 4,
    tables: int = 4,
    block_rows: int = 8192,
    seed: int = 1,
) -> DataFrame:
    """query_id, rank, vec_id, score: what ``top_k`` returns, from the buckets of random projections only.

    In each of ``tables`` tables a vector lies in the bucket of the signs of ``bits`` projections. A query looks into the
    2 ** free buckets that differ from its own in the projections it is least sure of, so at most the share
    tables * 2 ** (free - bits) of all vectors is scored, and their scores are exact; what lies in no such bucket is
    missed. More tables or a greater ``free`` find more, more ``bits`` score less: measure the recall on your vectors.
    The defaults suit vectors without any structure, the hardest case; where neighbours are close, ``free=1`` does.

    Every vector is copied once per table. Buckets of more than ``block_rows`` vectors, and their queries if they are more
    than ``block_rows``, are cut by a hash of the id, so copies of one vector, however many, are spread over tasks.
    Embeddings must have one length; null ones take no part.
    """
    vectors = vectors.select(F.col(vec_id).alias("vec_id"), _numbers(vectors, embedding)).where("embedding IS NOT NULL")
    queries = queries.select(F.col(query_id).alias("query_id"), _numbers(queries, embedding)).where("embedding IS NOT NULL")
    names = [d.dtypes[0][1] for d in (vectors, queries)]
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    planes = np.random.default_rng(seed).normal(size=(tables, bits, width))
    left = vectors.mapInArrow(_signed(planes, None), f"vec_id {names[0]}, embedding {vectors.dtypes[1][1]}, table int, key bigint")
    right = queries.mapInArrow(_signed(planes, free), f"query_id {names[1]}, embedding {queries.dtypes[1][1]}, table int, key bigint")

    def parts(df: DataFrame, name: str) -> DataFrame:
        return F.broadcast(df.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias(name)))  # tables * 2 ** bits rows at most

    every = lambda name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1))
    told = parts(left, "down").join(parts(right, "across"), ["table", "key"])
    left, right = (df.join(F.broadcast(told), ["table", "key"]) for df in (left, right))
    left = left.withColumn("part", F.pmod(F.xxhash64("vec_id"), "down")).withColumn("asked", every("across")).drop("down", "across")
    right = right.withColumn("asked", F.pmod(F.xxhash64("query_id"), "across")).withColumn("part", every("down")).drop("down", "across")
    cell = ["table", "key", "part", "asked"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cells(k, None, TILE_BYTES), f"query_id {names[1]}, vec_id {names[0]}, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of the exact answers that were found."""
    told = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return told.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def contexts(ranked: DataFrame, chunks: DataFrame, query: str = "query_id", chunk: str = "vec_id") -> DataFrame:
    """One text per query: its chunks in rank order, each under its source.

    ``chunks``: chunk id, source, page_content. At most k rows meet per query.
    """
    part = F.concat(F.lit("[Source: "), F.coalesce("source", F.lit("unknown")), F.lit("]\n"), F.col("page_content"))
    return (
        ranked.join(chunks, chunk)
        .groupBy(query)
        .agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
        .select(query, F.size("parts").alias("num_retrieved_docs"), F.array_join(F.col("parts.part"), "\n\n").alias("context"))
    )


def context_rows(ranked: DataFrame, chunks: DataFrame, chunk: str = "vec_id", preview: int = 500) -> DataFrame:
    """Ranked rows with source, preview and score, as they are kept for provenance."""
    return ranked.join(
        chunks.select(chunk, F.col("source").alias("document_filename"), F.substring("page_content", 1, preview).alias("content_preview")), chunk
    )


def search_digest(
    searches: DataFrame, results: DataFrame, *, per_search: int, max_searches: int, cut: int, key: str = "chunk_id"
) -> DataFrame:
    """One text per chunk: its first searches, each with its first results shortened.

    ``searches``: key, search_rank, search_query. ``results``: key, search_rank, result_rank,
    title, url, content. Ranks start at 1, so both caps, which the caller names, are filters and no
    group grows.
    """
    summary = F.when(F.length("content") > cut, F.concat(F.substring("content", 1, cut), F.lit("..."))).otherwise(F.col("content"))
    line = F.concat(
        F.lit("  • "), F.coalesce("title", F.lit("")), F.lit(": "), summary, F.lit("\n    Source: "), F.coalesce("url", F.lit(""))
    )
    shown = (
        results.where((F.col("result_rank") <= per_search) & (F.col("search_rank") <= max_searches))
        .where("content is not null and content <> ''")
        .select(key, "search_rank", F.col("result_rank").alias("place"), line.alias("line"))
    )
    heads = searches.where(F.col("search_rank") <= max_searches).select(
        key, "search_rank", F.lit(0).alias("place"), F.concat(F.lit("\n🔍 Query: "), "search_query").alias("line")
    )
    lines = heads.unionByName(shown.join(heads.select(key, "search_rank"), [key, "search_rank"], "left_semi"))
    return (
        lines.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("search_rank", "place", "line"))).alias("lines"))
        .select(key, F.array_join(F.col("lines.line"), "\n").alias("grounding"))
    )
