"""From raw documents to tokens: quality, near duplicates, repeated passages, mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the last return the
columns of the documents; extra columns pass through. Null and empty texts, null or repeated ids and empty tables are
handled as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import blocks, bpe, mixing, quality_model, simhash, suffix_array
from gaugeflow.llm.sampling import crc_part
from gaugeflow.llm.shared import small_batches, stored

LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose passages score at least LEAST_QUALITY; the model learns from the labels of rows that are not held out."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_part(F.col("doc_id"), 4) != 2)
    told = quality_model.score(docs, quality_model.fit(docs, labels), carry=("*",))
    return told.where(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within two bits: the one with the smallest id (of several, the least by all columns)."""
    small_batches(spark)
    told = simhash.near_duplicates(docs, shingle=3, max_bits=2)
    return told.where(F.col("row.doc_id").eqNullSafe(F.col("component"))).groupBy("root").agg(F.min("row").alias("row")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 50-byte strings that start in a document with a smaller id; a null text becomes empty."""
    small_batches(spark)
    told = suffix_array.remove_repeats(docs, as_text=True)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return told.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources have the shares 5, 2, 1, ... of all words, none more than 3 times."""
    return mixing.repeated(docs, weights=(5, 2, 1), max_epochs=3.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers), and whether decoding gives the text back."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    hashed = docs.select("doc_id", "source", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    encoded = bpe.encode(hashed, path=path, pattern=public_tokenizers.PATTERN, carry=("doc_id", "source", "sha"))
    same = F.sha2(bpe.decode(F.col("ids"), path=path), 256) == F.col("sha")
    return encoded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("mixing", mixture),
    ("byte_level_bpe", tokens),
]

ORACLE_SQL = None  # a trained model, fingerprints and merges have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        blocks.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
