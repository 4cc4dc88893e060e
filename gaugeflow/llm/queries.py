"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import bpe, divergence, exact_topk, html_text, language, language_model, lexical, mixing, packing, quality_model, quality_rules, simhash, suffix_array
from gaugeflow.llm.sampling import crc_part
from gaugeflow.llm.shared import small_batches
from gaugeflow.operators.layout import small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op6_mixing",
    rf"""
    WITH base AS (
        SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':{mixing.SEED}:', coalesce(md5(text), ''))) AS o,
               coalesce(len(regexp_extract_all(text, '{mixing.WORDS}')), 0) AS size
        FROM documents
    ), sources AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS words FROM base GROUP BY source
    ), weighted AS (
        SELECT source, words, words * 3.0::DOUBLE AS cap,
               [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
        FROM sources
    ), filled AS (
        SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS n, ((SELECT sum(words) FROM sources)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / (sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
        FROM weighted
    ), chosen AS (
        SELECT coalesce(arg_min(level, n) FILTER (level * weight <= cap), 0) AS level FROM filled
    ), targets AS (
        SELECT source, words, least(cap, (SELECT level FROM chosen) * weight) AS target FROM weighted
    ), wholes AS (
        SELECT *, CASE WHEN words > 0 THEN CAST(floor(target / words) AS BIGINT) ELSE 0 END AS whole FROM targets
    ), placed AS (
        SELECT b.doc_id, b.size, w.words AS source_size, w.target, w.whole, w.target - w.whole * w.words AS rest,
               2 * coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.o, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b.size AS middle
        FROM base b JOIN wholes w ON b.source IS NOT DISTINCT FROM w.source
    )
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(size * (whole + CASE WHEN middle <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM placed
    """,
)
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), carry=("doc_id",))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_part(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held_out), F.col("text"), F.col("lang"))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    ratio = quality_rules.fit(docs.join(small(good), "doc_id", "left"), F.col("text"), F.col("trusted"))
    return quality_rules.judge(docs, ratio)


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_part(F.col("doc_id"), 4) == 2
    model = quality_model.fit(docs, table(spark, folder, "labels").where(~held_out))
    predicted = (F.col("score") >= 0.7).cast("int")
    scored = quality_model.score(docs, model, carry=("doc_id",))
    return scored.select("row.doc_id", "score", predicted.alias("predicted")).withColumn("held_out", crc_part(F.col("doc_id"), 4) == 2).select("doc_id", "held_out", "score", "predicted")


@query("op7_simhash")
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    told = simhash.near_duplicates(table(spark, folder, "documents"), carry=("doc_id",))
    return told.select("row.doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query(
    "op8_exact_topk",
    """
    WITH usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
        FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
    QUALIFY rank <= 10
    """,
)
def op8_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), exact_topk.scaled(F.col("embedding"), 1024).alias("vector"))
    return exact_topk.top_k(rows, rows.where("id % 100 = 0"), k=10)


@query("op3_html_text")
def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_text.extract(pages, html_text.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, folder, "documents"), path=path, pattern=public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), path=path), 256).alias("decoded_sha256"),
    )


@query("op5_language_model")
def op5_language_model(spark: SparkSession, folder: str) -> DataFrame:
    held_out = crc_part(F.col("doc_id"), 7) == 2
    scored = language_model.score(table(spark, folder, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_suffix_array")
def op4_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    told = suffix_array.remove_repeats(table(spark, folder, "documents"), carry=("doc_id",))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return told.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_lexical_search",
    rf"""
    WITH words AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents WHERE text IS NOT NULL
    ), docs AS (
        SELECT r, doc_id, terms, len(terms) AS own FROM words WHERE len(terms) > 0
    ), total AS (
        SELECT count(*) AS docs_all, CAST(sum(own) AS BIGINT) AS terms_all FROM docs
    ), counts AS (
        SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counts, total GROUP BY term, docs_all
    ), items AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ), scored AS (
        SELECT i.item_id, d.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * own * docs_all) // terms_all)))) AS BIGINT) AS score
        FROM items i JOIN counts c USING (term) JOIN weights USING (term) JOIN docs d USING (r), total
        GROUP BY i.item_id, r, d.doc_id
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 50
    """,
)
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


@query("op12_packing")
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), path=public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query(
    "op13_divergence",
    rf"""
    WITH base AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ), groups AS (
        SELECT DISTINCT lang, source FROM base
    ), tokens AS (
        SELECT r, lang, source, unnest(terms) AS term FROM base
    ), kept AS (
        SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 30
    ), sizes AS (
        SELECT lang, count(*) AS V FROM kept GROUP BY lang
    ), counts AS (
        SELECT lang, source, term, count(*) AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
    ), totals AS (
        SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM counts GROUP BY lang, source
    ), p AS (
        SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
               CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(t.n, 0) + 5 * V) AS BIGINT) AS p
        FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
    ), q AS (
        SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (CAST(sum(c) AS BIGINT) + 5)) // ((SELECT sum(n) FROM totals t WHERE t.lang = p.lang) + 5 * any_value(V)) AS BIGINT) AS q
        FROM p JOIN sizes USING (lang) GROUP BY lang, term
    ), pairs AS (
        SELECT a.lang, a.source, b.source AS item, CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    ), best AS (
        SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
    )
    SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM best QUALIFY rank <= 50
    """,
)
def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))
