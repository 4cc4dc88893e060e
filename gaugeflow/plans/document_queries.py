"""Documents, chunks and retrieval (S6, D1-D9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeflow.operators import documents as dc
from gaugeflow.operators import retrieval as rt
from gaugeflow.plans.registry import query, table
from gaugeflow.sources import documents as sd


@query(
    "s06_ingest_texts",
    "SELECT doc_id, sha256(text) AS content_hash, octet_length(encode(text)) AS file_size, 'not_uploaded' AS sync_status FROM documents",
)
def ingest_texts(spark: SparkSession, folder: str) -> DataFrame:
    return sd.ingest_texts(table(spark, folder, "documents")).select("doc_id", "content_hash", "file_size", "sync_status")


@query("s06_ingest_files")
def ingest_files(spark: SparkSession, folder: str) -> DataFrame:
    return sd.ingest_files(spark, folder, "*.parquet").select("filename", "content_hash", "file_size", "mime_type", "sync_status")


CHUNKS = """
cuts AS (SELECT doc_id, source, lang, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 200) / 800.0) AS BIGINT)))) AS chunk_index
  FROM documents WHERE text <> ''),
chunks AS (SELECT doc_id, source, lang, chunk_index, substr(text, chunk_index * 800 + 1, 1000) AS page_content FROM cuts)
"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", "lang", "text")


@query("d01_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_index, page_content FROM chunks")
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return dc.chunk(documents(spark, folder).select("doc_id", "text"))


@query("d01_chunks_by_separator")
def chunks_by_separator(spark: SparkSession, folder: str) -> DataFrame:
    return dc.chunk_by_separator(documents(spark, folder).select("doc_id", "text"))


@query(
    "d01_separator_properties",
    r"""SELECT doc_id, 0 AS too_long, 0 AS words_lost, true AS from_start, true AS to_end FROM documents WHERE regexp_matches(text, '[^ \t\n\v\f\r]')""",
)
def separator_properties(spark: SparkSession, folder: str) -> DataFrame:
    """What holds of chunks that end at separators: none is too long, no word is lost, and they run from the start of a text to its end."""
    docs = documents(spark, folder).select("doc_id", "text")
    made = dc.chunk_by_separator(docs)
    words = lambda text: F.array_distinct(F.split(text, r"\s+"))
    of_chunks = made.groupBy("doc_id").agg(
        F.count_if(F.length("page_content") > 1000).cast("int").alias("too_long"),
        F.array_distinct(F.flatten(F.collect_list(words(F.col("page_content"))))).alias("kept"),
        F.min_by("page_content", "chunk_index").alias("first"),
        F.max_by("page_content", "chunk_index").alias("last"),
    )
    both = of_chunks.join(docs, "doc_id")
    short = F.filter(words(F.col("text")), lambda w: (F.length(w) < 1000) & (w != ""))
    return both.select(
        "doc_id", "too_long", F.size(F.array_except(short, "kept")).alias("words_lost"),
        F.startswith(F.btrim("text", F.lit(" \t\n\x0b\f\r")), F.col("first")).alias("from_start"),
        F.endswith(F.btrim("text", F.lit(" \t\n\x0b\f\r")), F.col("last")).alias("to_end"),
    )


@query(
    "d02_chunk_records",
    f"""WITH {CHUNKS} SELECT doc_id, chunk_index, substr(page_content, 1, 500) AS content_preview, sha256(page_content) AS content_hash,
    length(page_content) AS chunk_size FROM chunks""",
)
def chunk_records(spark: SparkSession, folder: str) -> DataFrame:
    made = dc.chunk_records(dc.chunk(documents(spark, folder).select("doc_id", "text")))
    return made.select("doc_id", "chunk_index", "content_preview", "content_hash", "chunk_size")


@query("d03_chunk_metadata", f"WITH {CHUNKS} SELECT doc_id, source, lang, chunk_index FROM chunks")
def chunk_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return dc.chunk(documents(spark, folder)).select("doc_id", "source", "lang", "chunk_index")


STATUS = "CASE doc_id % 4 WHEN 0 THEN 'not_uploaded' WHEN 1 THEN 'failed' WHEN 2 THEN 'uploading' ELSE 'uploaded' END"


def statused(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").withColumn("sync_status", F.expr(STATUS))


@query("d04_documents_to_sync", f"SELECT doc_id, source FROM documents WHERE {STATUS} IN ('not_uploaded', 'failed')")
def documents_to_sync(spark: SparkSession, folder: str) -> DataFrame:
    return dc.to_sync(statused(spark, folder)).select("doc_id", "source")


@query(
    "d05_sync_totals",
    f"""WITH {CHUNKS}, counts AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)
    SELECT source, count(*) AS total_documents, count(n) AS synced_documents, count(*) - count(n) AS failed_documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_chunks
    FROM documents LEFT JOIN counts USING (doc_id) WHERE {STATUS} IN ('not_uploaded', 'failed') GROUP BY source""",
)
def sync_totals(spark: SparkSession, folder: str) -> DataFrame:
    docs = statused(spark, folder)
    made = dc.chunk(docs.select("doc_id", "text"))
    return dc.sync_totals(dc.sync_outcomes(docs, made), "source")


TOP = """
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a, embeddings b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs),
top AS (SELECT * FROM ranked WHERE rank <= 5)
"""


def all_queries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return vectors, vectors.withColumnRenamed("vec_id", "query_id")


@query("d06_top_k", f"WITH {TOP} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM top")
def top_k(spark: SparkSession, folder: str) -> DataFrame:
    found = rt.top_k(*all_queries(spark, folder))
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("d06_top_k_grid", f"WITH {TOP} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM top")
def top_k_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The plan for more queries than one task may hold."""
    found = rt.top_k(*all_queries(spark, folder), broadcast_bytes=0, block_bytes=200 * 64 * 8, tile_bytes=1 << 14)
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("d06_near_top_k", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def near_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The bucketed search for every fiftieth vector against all: at least nine tenths of the exact answers."""
    vectors, queries = all_queries(spark, folder)
    asked = queries.where("query_id % 50 = 0")
    told = rt.recall(rt.near_top_k(vectors, asked), rt.top_k(vectors, asked))
    return told.select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query(
    "d07_contexts",
    f"""WITH {TOP} SELECT query_id, count(*) AS num_retrieved_docs,
    string_agg('[Source: ' || source || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
    FROM top JOIN documents ON doc_id = vec_id GROUP BY query_id""",
)
def contexts(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "source", F.col("text").alias("page_content"))
    return rt.contexts(rt.top_k(*all_queries(spark, folder)), texts)


@query(
    "d07_context_rows",
    f"""WITH {TOP} SELECT query_id, rank, vec_id, source AS document_filename, substr(text, 1, 500) AS content_preview
    FROM top JOIN documents ON doc_id = vec_id""",
)
def context_rows(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "source", F.col("text").alias("page_content"))
    found = rt.context_rows(rt.top_k(*all_queries(spark, folder)), texts)
    return found.select("query_id", "rank", "vec_id", "document_filename", "content_preview")


@query(
    "d08_search_digest",
    """WITH searches AS (SELECT conv_id AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS search_rank, text AS search_query
      FROM conversations WHERE role = 'user'),
    answers AS (SELECT conv_id AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS result_rank, 'turn ' || turn AS title, text AS content
      FROM conversations WHERE role = 'assistant'),
    lines AS (SELECT chunk_id, search_rank, 0 AS place, chr(10) || '🔍 Query: ' || search_query AS line FROM searches WHERE search_rank <= 4
      UNION ALL SELECT chunk_id, search_rank, result_rank, '  • ' || title || ': ' ||
        CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END || chr(10) || '    Source: conv ' || chunk_id
      FROM searches JOIN answers USING (chunk_id) WHERE search_rank <= 4 AND result_rank <= 2 AND content <> '')
    SELECT chunk_id, string_agg(line, chr(10) ORDER BY search_rank, place) AS grounding FROM lines GROUP BY chunk_id""",
)
def search_digest(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as searches, assistant turns as what each of them found."""
    turns = table(spark, folder, "conversations")
    place = F.row_number().over(W.partitionBy("chunk_id").orderBy("turn"))
    named = turns.withColumnRenamed("conv_id", "chunk_id")
    searches = named.where("role = 'user'").select("chunk_id", place.alias("search_rank"), F.col("text").alias("search_query"))
    found = named.where("role = 'assistant'").select(
        "chunk_id",
        place.alias("result_rank"),
        F.concat(F.lit("turn "), "turn").alias("title"),
        F.concat(F.lit("conv "), "chunk_id").alias("url"),
        F.col("text").alias("content"),
    )
    results = searches.select("chunk_id", "search_rank").join(found.where("result_rank <= 2"), "chunk_id")
    return rt.search_digest(searches, results, per_search=2, max_searches=4, cut=200)


@query(
    "d09_chunks_of_documents",
    f"""WITH {CHUNKS} SELECT doc_id AS document_id, chunk_index FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def chunks_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumnRenamed("doc_id", "document_id")
    made = dc.chunk(docs.select("document_id", "text"))
    chosen = table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    return dc.select_chunks(made, docs, 0, document_ids=chosen).select("document_id", "chunk_index")


@query(
    "d09_chunks_of_collection",
    f"""WITH {CHUNKS} SELECT doc_id AS document_id, chunk_index FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 5 = 2)""",
)
def chunks_of_collection(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(F.col("doc_id").alias("document_id"), "text", (F.col("doc_id") % 5).alias("collection_id"))
    return dc.select_chunks(dc.chunk(docs.select("document_id", "text")), docs, 2).select("document_id", "chunk_index")


@query(
    "d09_chunks_by_ids",
    f"""WITH {CHUNKS} SELECT doc_id AS document_id, chunk_index FROM chunks WHERE chunk_index = 1""",
)
def chunks_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumnRenamed("doc_id", "document_id")
    chunk_id = F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id")
    made = dc.chunk(docs.select("document_id", "text")).select("document_id", "chunk_index", chunk_id)
    wanted = docs.select(F.concat_ws(":", "document_id", F.lit(1)).alias("chunk_id"))
    return dc.select_chunks(made, docs, 0, chunk_ids=wanted).select("document_id", "chunk_index")
