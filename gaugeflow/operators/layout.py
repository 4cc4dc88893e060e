"""Keeping ordered work on one key from landing in one task.

Windows partition by key, so a key that holds a third of all rows would be one task. Keys above
a row bound are cut into ranges of equal row count instead, by Spark's range partitioner over
(key, order). The ranges are written once to the shared folder, so their numbers stay fixed if
executors are lost, and per-range counts give every row its position within the key.
"""

from __future__ import annotations

import math
import tempfile
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whether Spark removes what a statement shuffled when the statement ends, not when the driver collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Tables of at most this many rows and bytes may be broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def reliable_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints; a temporary one only where Spark runs in one process."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gaugeflow-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder: later reads are columnar and never recompute it."""
    path = f"{reliable_dir(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as columns in zstd, and what was shuffled for it removed before anything else runs: for a step of a long
    job, whose shuffles would otherwise all lie on disk until the job ends."""
    conf, path = df.sparkSession.conf, f"{reliable_dir(df.sparkSession)}/{name}-{uuid4().hex}"
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            conf.unset(DROP_SHUFFLES)
        else:
            conf.set(DROP_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, bound: int = BROADCAST_ROWS, bytes_bound: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``bound`` rows of ``bytes_bound`` bytes together, else as it is."""
    wide = [F.octet_length(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.octet_length(F.to_json(F.struct(f.name)))
            for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    size = reduce(lambda a, b: a + b, [F.coalesce(w, F.lit(0)) for w in wide], F.lit(8 * len(df.columns)))
    told = df.limit(bound + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    return F.broadcast(df) if told["rows"] <= bound and (told["bytes"] or 0) <= bytes_bound else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to all cores: for work that is dear per row, where a table of few files would be few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


@dataclass(frozen=True)
class Division:
    """Rows whose key fits one task, rows whose key does not, and how many the latter are."""

    fits: DataFrame | None
    hot: DataFrame | None
    hot_rows: int = 0


def divide(
    df: DataFrame, keys: list[str], layout: str, max_rows: int, sized: DataFrame | None = None, times: int = 1
) -> Division:
    """Split ``df`` by whether its key has more than ``max_rows`` rows.

    The count reads nothing but the keys. Where ``df`` is costly, ``sized`` is a cheaper table
    with as many rows per key, of which ``df`` has ``times`` as many.
    """
    if layout == "plain":
        return Division(df, None)
    if layout == "split":
        return Division(None, df, df.count())
    sizes = (df if sized is None else sized).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = sizes.where(F.col("_rows") > max_rows).persist()
    found = hot.agg(F.count(F.lit(1)).alias("keys"), F.sum("_rows").alias("rows")).first()
    if found["keys"] == 0:
        hot.unpersist()
        return Division(df, None)
    names = hot.select(*keys)
    names = F.broadcast(names) if found["keys"] <= BROADCAST_ROWS else names
    return Division(df.join(names, keys, "left_anti"), df.join(names, keys, "left_semi"), found["rows"] * times)


def ranges(df: DataFrame, keys: list[str], order: list[str], rows: int, rows_per_range: int) -> DataFrame:
    """Rows with ``_range``: ascending numbers of ranges of (keys, order), similar in row count."""
    parts = max(2, math.ceil(rows / rows_per_range))
    cut = df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id())
    return stored(cut, "ranges")


def positions(
    df: DataFrame, keys: list[str], order: list[str], counted: Column, name: str, rows: int, rows_per_range: int
) -> tuple[DataFrame, DataFrame]:
    """``name`` = how many non-null ``counted`` the key has up to this row, without one task per key, and ``_range``.

    Beside it a small table: what each key had counted (``_before``) ahead of each of its ranges.
    """
    cut = ranges(df, keys, order, rows, rows_per_range)
    per_range = cut.groupBy(*keys, "_range").agg(F.count(counted).alias("_inside"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys, "_range", F.coalesce(F.sum("_inside").over(earlier), F.lit(0)).alias("_before")
    )
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return cut.join(offsets, [*keys, "_range"]).withColumn(name, F.count(counted).over(inside) + F.col("_before")).drop("_before"), offsets


def running_count(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    counted: Column | None = None,
    name: str = "n",
    layout: str = "auto",
    max_rows: int = 4_000_000,
) -> DataFrame:
    """Position of each row within its key, for keys of any size."""
    counted = F.lit(1) if counted is None else counted
    split = divide(df, keys, layout, max_rows)
    parts = []
    if split.fits is not None:
        upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        parts.append(split.fits.withColumn(name, F.count(counted).over(upto)))
    if split.hot is not None:
        parts.append(positions(split.hot, keys, order, counted, name, split.hot_rows, max(1, max_rows // 4))[0].drop("_range"))
    return reduce(DataFrame.unionByName, parts)
