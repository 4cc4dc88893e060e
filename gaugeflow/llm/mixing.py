"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions in a seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.shared import ensure_checkpoint_dir
from gaugeflow.operators.layout import small

WORDS = r"[^\x20\x09-\x0D]+"
SEED = 11
RANK_PARTITIONS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def order_of(key: Column, text: Column, seed: int) -> Column:
    """The seeded place of a row in its source: rows of one key, or without one, are told apart by their texts."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(F.md5(text), F.lit(""))))


def _ranked(sources: DataFrame) -> DataFrame:
    """The sources with their position by code point, null last; each task ranks one range of names."""
    ensure_checkpoint_dir(sources.sparkSession)
    dealt = sources.repartitionByRange(RANK_PARTITIONS, F.col("_source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = (
        dealt.groupBy("_range").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_range", F.coalesce("_before", F.lit(0)).alias("_before"))
    )  # RANK_PARTITIONS rows at most
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("_source").asc_nulls_last()))
    return dealt.join(F.broadcast(before), "_range").withColumn("_place", F.col("_before") + place - 1).drop("_range", "_before")


def _water_level(sources: DataFrame) -> float:
    """The words per unit of weight at which capped targets add up to all words; one small sum per round, until no source is clamped anew."""
    level, clamped = 0.0, -1
    while True:
        over = F.lit(clamped >= 0) & (F.col("_cap") < F.lit(level) * F.col("_weight"))
        total, caps, weight, n = sources.agg(
            F.coalesce(F.sum("_words"), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0)).cast("double"),
            F.coalesce(F.sum(over.cast("int")), F.lit(0)),
        ).first()
        if weight == 0 or n == clamped:
            return level
        level, clamped = (total - caps) / weight, n


def mix(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), max_epochs: float = 3.0, seed: int = SEED, order_digits: int = 3, carry: tuple[str, ...] = ("*",),
) -> DataFrame:
    """Every document of docs with `row` (a struct of the input columns named in `carry`), `size`, `source_size`, `target` and `repeats`.

    Sources in order of their name (code points, null last) take the weights in turn and share all words by them;
    a target above max_epochs times its source's size is clamped there and the excess goes to the others by weight
    (water-filling). A document is repeated floor(target / size) times; the rest of the target is filled by whole
    documents in an order given by md5(key, seed, md5(text)), each taken if its middle lies before the rest's end, so a source's
    words differ from its target by half a document at most. Reruns agree: nothing depends on partitions.

    Only a slice of 16 ** -order_digits of a source is ever ordered in one task: slices before and after the one in
    which the rest ends are decided as a whole, and rows of one key are dealt by their texts (only equal rows share a place). The join is on (source, slice), so a source of any share is spread; slices within the bounds of
    ``layout.small`` are broadcast, so texts are not shuffled.

    Null or empty texts have size 0 and are repeated like others; null keys order as the empty string; a null source
    is a source. Repeated rows count each. Empty input gives no rows; extra columns stay inside `row`.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    order = order_of(docs[key], docs[text], seed)
    base = docs.select(F.struct(*carry).alias("row"), docs[source].alias("_source"), word_count(docs[text]).alias("size"), order.alias("_order"))
    base = base.withColumn("_slice", F.substring("_order", 1, order_digits))
    slices = base.groupBy("_source", "_slice").agg(F.sum("size").alias("_own")).checkpoint()  # 16 ** order_digits rows a source at most
    sources = _ranked(slices.groupBy("_source").agg(F.sum("_own").alias("_words")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    sources = sources.select("_source", "_words", weight.alias("_weight"), (F.col("_words") * F.lit(float(max_epochs))).alias("_cap")).checkpoint()
    level = _water_level(sources)
    sources = sources.withColumn("target", F.least("_cap", F.lit(level) * F.col("_weight")))
    whole = F.when(F.col("_words") > 0, F.floor(F.col("target") / F.col("_words"))).otherwise(0).cast("long")
    sources = sources.select(F.col("_source").alias("_name"), "_words", "target", whole.alias("_whole"), (F.col("target") - whole * F.col("_words")).alias("_rest"))
    before = F.coalesce(F.sum("_own").over(Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.withColumn("_before", before).join(sources, F.col("_source").eqNullSafe(F.col("_name")))
    slices = slices.select(
        "_name", F.col("_slice").alias("_part"), F.col("_words").alias("source_size"), "target", "_whole", "_rest", "_before",
        # 1: every document of the slice is taken once more, 0: none, null: the rest ends inside or near the slice
        F.when(F.col("_rest") <= 0, 0).when(F.col("_before") + F.col("_own") <= F.col("_rest"), 1).when(F.col("_before") >= F.col("_rest"), 0).alias("_more"),
    )
    told = base.join(small(slices), F.col("_source").eqNullSafe(F.col("_name")) & (F.col("_slice") == F.col("_part")))
    out = ["row", "size", "source_size", "target"]
    decided = told.where(F.col("_more").isNotNull()).select(*out, (F.col("_whole") + F.col("_more")).alias("repeats"))
    ahead = Window.partitionBy("_name", "_part").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = 2 * (F.col("_before") + F.coalesce(F.sum("size").over(ahead), F.lit(0))) + F.col("size")
    split = told.where(F.col("_more").isNull()).withColumn("_middle", middle)
    return decided.unionByName(split.select(*out, (F.col("_whole") + (F.col("_middle") <= 2 * F.col("_rest")).cast("long")).alias("repeats")))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document of docs as often as mix() repeats it, with the columns of docs."""
    return mix(docs, **options).where("repeats > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("_copy")).select("row.*")
