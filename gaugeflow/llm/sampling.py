"""A bounded sample of labelled rows to fit a classifier on; every other row only gets scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.layout import small

MOST_ROWS = 20_000
LEAST_EACH = 20


def crc_part(key: Column, parts: int) -> Column:
    """crc32 of the key's text, modulo parts; null keys fall in part 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts, F.lit(0))


def per_class(rows: DataFrame, label: str, each: int, most: int = MOST_ROWS) -> DataFrame:
    """About `each` rows of every label (all of a rarer one), drawn row by row; null labels are left out.

    A row is drawn by a hash of its place in the scan, so rows that are alike, or share a key or have none, are drawn
    like any others, and a run over the same files draws the same rows. With so many labels that `each` of all would
    be more than `most` rows, every label gets fewer, LEAST_EACH at least: no label is left out.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_rows"))
    labels = counts.count()
    if not labels:
        return rows.limit(0)
    rate = F.lit(float(max(LEAST_EACH, min(each, most // labels)))) / F.col("_rows")
    # twenty draws or so may be none by chance: rare labels are taken whole
    rates = counts.select("_label", F.when(F.col("_rows") <= 2 * LEAST_EACH, F.lit(1.0)).otherwise(rate).alias("_rate"))
    place = F.xxhash64(F.monotonically_increasing_id(), F.lit("sample")).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    drawn = rows.withColumn("_place", place).join(small(rates), F.col(label) == F.col("_label"))
    return drawn.where(F.col("_place") < F.col("_rate")).drop("_place", "_label", "_rate")
