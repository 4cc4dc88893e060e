"""Requirements to feature columns: lookbacks and rolling statistics per (asset, sensor).

With n = number of non-null samples so far, a RANGE frame on n is "the last w samples": a null
row shares n with the sample before it, so statistics carry over nulls without a join. Frames
up to ``wide_window`` samples are ordinary sliding frames. Longer ones are cut into blocks of w
samples, where every window is the tail of one block plus the head of the next; running
aggregates over both make the cost per row independent of w, and nothing is subtracted.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.timeexpr import Duration, Interval
from gaugeflow.model import CheckerConfig, Requirement
from gaugeflow.operators import layout, sliding

KEYS = ["asset", "sensor_id"]
ORDER = ["ts_us", "seq"]
ROW = ["asset", "sensor_id", "ts", "ts_us", "seq", "value"]

# Statistics whose windows can be put together from two parts, and the parts they need.
PARTS = {
    "mean": ("sum", "count"),
    "sum": ("sum",),
    "count": ("count",),
    "max": ("max",),
    "min": ("min",),
    "abs_max": ("abs_max",),
    "variance": ("count", "avg", "m2"),
    "std": ("count", "avg", "m2"),
}
STATISTICS = (*PARTS, "quantile", "iqr", "mode")
ZERO_START = ("mean", "variance", "std", "sum")
# Rows of one sensor that Python may hold at a time, next to the history its windows reach back to.
PYTHON_ROWS = 500_000


def over_frame(statistic: str, value: Column, frame, q: float = 0.5) -> Column | None:
    """A statistic of ``value`` over a window frame; None for an unknown statistic."""
    match statistic:
        case "mean":
            return F.avg(value).over(frame)
        case "variance":
            return F.var_samp(value).over(frame)
        case "std":
            return F.stddev_samp(value).over(frame)
        case "sum":
            return F.sum(value).over(frame)
        case "max":
            return F.max(value).over(frame)
        case "min":
            return F.min(value).over(frame)
        case "abs_max":
            return F.max(F.abs(value)).over(frame)
        case "quantile":
            return F.percentile(value, F.lit(q)).over(frame)
        case "iqr":
            return F.percentile(value, F.lit(0.75)).over(frame) - F.percentile(value, F.lit(0.25)).over(frame)
        case "mode":
            return F.mode(value, True).over(frame)
        case "count":
            return F.count(value).over(frame)
    return None


@dataclass(frozen=True)
class Series:
    """One (time expression, statistic) resolved against a configuration."""

    name: str
    kind: str  # current, lookback, window, empty
    statistic: str | None = None
    start: int = 0  # samples or microseconds back to the start
    end: int = 0


def resolve(req: Requirement, config: CheckerConfig) -> Series:
    """Frame of a requirement; ``empty`` where the reading has no answer and stays null."""
    try:
        when = Interval.parse(req.time_expression)
    except ValueError:
        return Series(req.series, "empty")
    step = Duration.parse(config.granularity).us if config.mode == "samples" else 1
    start, end = when.start.us // step, (when.end.us // step if when.is_interval else 0)
    if not when.is_interval:
        if not when.start:
            return Series(req.series, "current")
        if config.mode == "samples" and config.max_history_buffer_size is not None and start >= config.max_history_buffer_size:
            return Series(req.series, "empty")
        return Series(req.series, "lookback", None, start, start)
    length = when.length.us // step
    if length <= 0 or req.statistic not in STATISTICS:
        return Series(req.series, "empty")
    end = 0 if config.end_offset == "ignore" else end
    return Series(req.series, "window", req.statistic, length + end, end)


def series_of(requirements: Iterable[Requirement], config: CheckerConfig) -> list[Series]:
    """Distinct series: requirements that ask for the same thing share one column."""
    return list({req.series: resolve(req, config) for req in requirements}.values())


def features(
    readings: DataFrame,
    requirements: Iterable[Requirement],
    config: CheckerConfig = CheckerConfig(),
    filled_from: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """Readings plus one column per distinct (time expression, statistic).

    ``readings`` is canonical: asset, sensor_id, ts, ts_us, seq, value, with (asset, sensor_id,
    ts_us, seq) unique. If they were filled up to a row per sensor and moment, ``filled_from`` is
    the table they came from and the number of sensors: row counts are then taken there.
    """
    series = series_of(requirements, config)
    if any(_in_python(s, config) for s in series):
        config = replace(config, max_task_rows=min(config.max_task_rows, PYTHON_ROWS))
    if filled_from is None:
        split = layout.divide(readings, KEYS, config.layout, config.max_task_rows)
    else:
        split = layout.divide(readings, ["asset"], config.layout, config.max_task_rows, *filled_from)
    parts = []
    if config.mode == "time":
        if split.fits is not None:
            parts.append(_time_frames(split.fits, KEYS, series, config))
        if split.hot is not None:
            parts.append(_time_split(split.hot, split.hot_rows, series, config))
    else:
        if split.fits is not None:
            upto = W.partitionBy(*KEYS).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
            parts.append(_sample_frames(split.fits.withColumn("n", F.count("value").over(upto)), KEYS, series, config))
        if split.hot is not None:
            parts.append(_sample_split(split.hot, split.hot_rows, series, config))
    return reduce(DataFrame.unionByName, parts)


def _in_python(s: Series, config: CheckerConfig) -> bool:
    """Whether a series is computed on Arrow groups: windows by the clock, long order statistics and the long mode."""
    return s.kind == "window" and (config.mode == "time" or (s.start - s.end >= config.wide_window and s.statistic not in PARTS))


def _from_start(column: Column, s: Series, config: CheckerConfig) -> Column:
    """Value of a series before it has seen enough samples."""
    zero = s.statistic == "count" or (config.warmup == "zero" and s.statistic in ZERO_START)
    return F.coalesce(column, F.lit(0.0)) if s.kind == "window" and zero else column


def _finish(df: DataFrame, keep: list[str], series: list[Series], columns: dict[str, Column], config: CheckerConfig) -> DataFrame:
    out = []
    for s in series:
        if s.kind == "current":
            column = F.col("value")
        elif s.kind == "empty":
            column = F.lit(None).cast("double")
        else:
            column = columns[s.name].cast("double")
        column = _from_start(column, s, config)
        if s.kind == "window" and config.mode == "samples" and config.min_samples > 1:
            column = F.when(F.col("n") >= config.min_samples + s.end, column)
        out.append(column.alias(s.name))
    return df.select(*keep, *out)


def _at(df_keys: list[str], back: int):
    """The rows exactly ``back`` samples ago."""
    return W.partitionBy(*df_keys).orderBy("n").rangeBetween(-back, -back)


def _sample_frames(df: DataFrame, keys: list[str], series: list[Series], config: CheckerConfig, keep: list[str] = ROW) -> DataFrame:
    """Series of readings that carry ``n``; every partition of ``keys`` holds the history it needs."""
    columns: dict[str, Column] = {}
    blocks, ranked = [], []
    for s in series:
        length = s.start - s.end
        if s.kind == "lookback":
            columns[s.name] = F.max("value").over(_at(keys, s.start))
        elif s.kind == "window":
            if length >= config.wide_window and s.statistic in PARTS:
                blocks.append(s)
            elif _in_python(s, config):
                ranked.append(s)
            else:
                frame = W.partitionBy(*keys).orderBy("n").rangeBetween(1 - s.start, -s.end)
                columns[s.name] = over_frame(s.statistic, F.col("value"), frame, config.quantile)
    # Sliding and lookback columns first: they share the order of n.
    if columns:
        df = df.withColumns(columns)
        columns = {name: F.col(f"`{name}`") for name in columns}
    if blocks:
        df, merged = _block_windows(df, keys, blocks)
        columns |= merged
    if ranked:
        df = _ranked_windows(df, keys, ranked, config)
        columns |= {s.name: F.col(f"`{s.name}`") for s in ranked}
    return _finish(df, keep, series, columns, config)


def _block_windows(df: DataFrame, keys: list[str], series: list[Series]) -> tuple[DataFrame, dict[str, Column]]:
    value = F.col("value")
    part_of = {
        "sum": lambda frame: F.sum(value).over(frame),
        "count": lambda frame: F.count(value).over(frame),
        "avg": lambda frame: F.avg(value).over(frame),
        "m2": lambda frame: F.var_pop(value).over(frame) * F.count(value).over(frame),
        "max": lambda frame: F.max(value).over(frame),
        "min": lambda frame: F.min(value).over(frame),
        "abs_max": lambda frame: F.max(F.abs(value)).over(frame),
    }
    needed: dict[int, dict[str, None]] = {}
    for s in series:
        needed.setdefault(s.start - s.end, {}).update(dict.fromkeys(PARTS[s.statistic]))
    df = df.withColumns({f"_block{w}": F.floor((F.col("n") - 1) / F.lit(w)) for w in needed})
    runs = {}
    for w, parts in needed.items():
        block = W.partitionBy(*keys, f"_block{w}")
        head = block.orderBy("n").rangeBetween(W.unboundedPreceding, 0)
        tail = block.orderBy(F.col("n").desc()).rangeBetween(W.unboundedPreceding, 0)
        for part in parts:
            runs[f"_head{w}_{part}"] = part_of[part](head)
            runs[f"_tail{w}_{part}"] = part_of[part](tail)
    df = df.withColumns(runs)
    df = df.withColumns(
        {f"_first{w}_{part}": F.max(f"_tail{w}_{part}").over(_at(keys, w - 1)) for w, parts in needed.items() for part in parts}
    )
    merged = {}
    for s in series:
        w = s.start - s.end
        whole = (F.col("n") % w == 0) | (F.col("n") < w)

        def both(part: str, combine, w=w, whole=whole) -> Column:
            head, tail = F.col(f"_head{w}_{part}"), F.col(f"_first{w}_{part}")
            return F.when(whole, head).otherwise(combine(head, tail))

        match s.statistic:
            case "sum" | "count":
                column = both(s.statistic, lambda a, b: a + b)
            case "mean":
                column = F.try_divide(both("sum", lambda a, b: a + b), both("count", lambda a, b: a + b))
            case "max" | "abs_max":
                column = both(s.statistic, F.greatest)
            case "min":
                column = both("min", F.least)
            case _:
                n1, n2 = F.col(f"_head{w}_count"), F.col(f"_first{w}_count")
                gap = F.col(f"_head{w}_avg") - F.col(f"_first{w}_avg")
                m2 = both("m2", lambda a, b, n1=n1, n2=n2, gap=gap: a + b + gap * gap * F.try_divide(n1 * n2, n1 + n2))
                count = both("count", lambda a, b: a + b)
                column = F.when(count > 1, m2 / (count - 1))
                column = F.sqrt(column) if s.statistic == "std" else column
        merged[s.name] = column
    moved = {s.name: s.end for s in series if s.end}
    if moved:
        df = df.withColumns({f"_now_{name}": merged[name] for name in moved})
        merged |= {name: F.max(f"`_now_{name}`").over(_at(keys, end)) for name, end in moved.items()}
    return df, merged


def _ranked_windows(df: DataFrame, keys: list[str], series: list[Series], config: CheckerConfig) -> DataFrame:
    """Long rolling quantiles and modes, one (asset, sensor, range) at a time; groups are bounded by the layout."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(s.name, T.DoubleType()) for s in series])

    def roll(rows: pd.DataFrame) -> pd.DataFrame:
        samples = rows[rows["value"].notna()].sort_values("n")
        rows = rows.copy()
        if samples.empty:
            return rows.assign(**{s.name: np.nan for s in series})
        for s in series:
            window = samples["value"].rolling(s.start - s.end, min_periods=1)
            if s.statistic == "mode":
                answer = sliding.rolled(samples["value"].to_numpy(), s.start - s.end, "mode")
            elif s.statistic == "iqr":
                answer = (window.quantile(0.75) - window.quantile(0.25)).to_numpy()
            else:
                answer = window.quantile(config.quantile).to_numpy()
            place = rows["n"].to_numpy() - samples["n"].iloc[0] - s.end
            rows[s.name] = np.where(place >= 0, answer[np.maximum(place, 0)], np.nan)
        return rows

    ranked = df.groupBy(*keys).applyInPandas(roll, schema)
    return ranked.withColumns({s.name: F.nanvl(f"`{s.name}`", F.lit(None)) for s in series})


def _sample_split(df: DataFrame, rows: int, series: list[Series], config: CheckerConfig) -> DataFrame:
    """Sensors too long for one task: equal ranges of n, each with the history before it."""
    reach = max([s.start for s in series] + [1]) + 1
    size = max(config.max_task_rows // 4, 4 * reach)
    numbered, offsets = layout.positions(df, KEYS, ORDER, F.col("value"), "n", rows, max(1, config.max_task_rows // 4))
    home = F.floor((F.col("n") - 1) / F.lit(size))
    copies = F.when(F.col("n") > (home + 1) * size - reach, F.array(home, home + 1)).otherwise(F.array(home))
    samples = numbered.where("value is not null").withColumn("_bucket", F.explode(copies))
    computed = _sample_frames(samples, KEYS + ["_bucket"], series, config, ROW + ["n", "_range", "_bucket"])
    computed = computed.where(F.col("_bucket") == home)
    filled = computed.select(*ROW, *[f"`{s.name}`" for s in series])
    # Null rows answer like the sample before them, apart from their own current value. A sensor may be null from one
    # sample to its end, or have none: rows meet that sample per range, not all in one task.
    later = offsets.groupBy(*KEYS, F.col("_before").alias("n")).agg(F.collect_list("_range").alias("_later"))
    answers = computed.select(*KEYS, "n", "_range", *[f"`{s.name}`" for s in series if s.kind != "current"]).join(F.broadcast(later), KEYS + ["n"], "left")
    ranges = F.concat(F.array("_range"), F.coalesce("_later", F.array().cast("array<int>")))
    answers = answers.withColumn("_range", F.explode(ranges)).drop("_later")
    nulls = numbered.where("value is null").join(answers, KEYS + ["n", "_range"], "left")
    known = [
        F.lit(None).cast("double").alias(s.name) if s.kind == "current" else _from_start(F.col(f"`{s.name}`"), s, config).alias(s.name)
        for s in series
    ]
    return filled.unionByName(nulls.select(*ROW, *known))


def _time_frames(df: DataFrame, keys: list[str], series: list[Series], config: CheckerConfig, keep: list[str] = ROW, carry: bool = False) -> DataFrame:
    columns = {}
    windows = [s for s in series if s.kind == "window"]
    if windows:
        df = _clock_windows(df, keys, windows, config)
        columns = {s.name: F.nanvl(F.col(f"`{s.name}`"), F.lit(None)) for s in windows}
    by_time = W.partitionBy(*keys).orderBy("ts_us")
    sample = F.struct("ts_us", "seq", "value")
    for s in series:
        if s.kind == "lookback":
            last = F.max(F.when(F.col("value").isNotNull(), sample)).over(
                by_time.rangeBetween(W.unboundedPreceding, -s.start)
            )
            columns[s.name] = last["value"]
            if carry:
                columns[s.name] = F.coalesce(columns[s.name], F.col(f"`_carry_{s.name}`"))
    return _finish(df, keep, series, columns, config)


def _clock_windows(df: DataFrame, keys: list[str], series: list[Series], config: CheckerConfig) -> DataFrame:
    """Windows by the clock, one (asset, sensor, bucket) at a time: ``sliding`` makes a row cost the same however many the window holds."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(s.name, T.DoubleType()) for s in series])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ts_us", "ascending"), ("seq", "ascending")])
        at, value = rows.column("ts_us").to_numpy(), rows.column("value").fill_null(np.nan).to_numpy()
        there = ~np.isnan(value)
        when, value = at[there], value[there]
        for s in series:
            low, high = np.searchsorted(when, at - s.start + 1, "left"), np.searchsorted(when, at - s.end, "right")
            rows = rows.append_column(s.name, pa.array(sliding.over_ranges(value, low, np.maximum(low, high), s.statistic, config.quantile)))
        return rows

    return df.groupBy(*keys).applyInArrow(run, schema)


def _time_split(df: DataFrame, rows: int, series: list[Series], config: CheckerConfig) -> DataFrame:
    """Sensors too long for one task: buckets of rows, each with the history its windows reach back to.

    Ranges of similar row count whose first rows lie in one stretch of the longest lookback are one bucket. So a bucket
    holds a range of rows or those of one lookback, and history comes from the two buckets before it at most.
    """
    reach = max([s.start for s in series] + [1])
    cut = layout.ranges(df, KEYS, ORDER, rows, max(1, config.max_task_rows // 4))
    firsts = cut.groupBy(*KEYS, "_range").agg(F.min("ts_us").alias("first")).withColumn("_cell", F.floor(F.col("first") / F.lit(reach)))
    by = W.partitionBy(*KEYS).orderBy("_cell")
    buckets = firsts.groupBy(*KEYS, "_cell").agg(F.min("first").alias("start")).withColumns({"_bucket": F.row_number().over(by), **{f"_start{k}": F.lead("start", k).over(by) for k in (1, 2, 3)}})
    placed = cut.join(layout.small(firsts.join(buckets, [*KEYS, "_cell"]).drop("first", "start", "_cell")), [*KEYS, "_range"]).drop("_range")
    bucket, at = F.col("_bucket"), F.col("ts_us")
    moved = F.coalesce(at >= F.col("_start1"), F.lit(False))  # rows of one instant belong together
    copies = [F.when(~moved, bucket), *[F.when(at > F.col(f"_start{k}") - reach, bucket + k) for k in (1, 2, 3)]]
    placed = placed.withColumns({"_home": bucket + moved.cast("int"), "_copies": F.filter(F.array(*copies), lambda b: b.isNotNull())})
    spread = placed.withColumn("_bucket", F.explode("_copies")).drop("_copies", "_start1", "_start2", "_start3")
    lookbacks = [s for s in series if s.kind == "lookback"]
    if lookbacks:
        spread = spread.join(_carried(placed, buckets, reach, lookbacks), [*KEYS, "_bucket"], "left")
    computed = _time_frames(spread, [*KEYS, "_bucket"], series, config, [*ROW, "_bucket", "_home"], carry=bool(lookbacks))
    return computed.where("_bucket = _home").drop("_bucket", "_home")


def _carried(placed: DataFrame, buckets: DataFrame, reach: int, lookbacks: list[Series]) -> DataFrame:
    """Per bucket, the last sample before its copied history: what an older lookback still sees."""
    sample = F.struct("ts_us", "seq", "value")
    starts = buckets.select(*KEYS, F.col("_bucket").alias("_home"), "_start1", "_start2")
    ended = placed.where("value is not null").select(*KEYS, "_home", "ts_us", "seq", "value").join(layout.small(starts), [*KEYS, "_home"])
    before = lambda k: F.max(F.when(F.col("ts_us") <= F.col(f"_start{k}") - reach, sample))
    ends = ended.groupBy(*KEYS, "_home").agg(F.max(sample).alias("last"), before(1).alias("early1"), before(2).alias("early2"))
    by = W.partitionBy(*KEYS).orderBy("_bucket")
    all_ends = buckets.join(ends.withColumnRenamed("_home", "_bucket"), [*KEYS, "_bucket"], "left")
    older = F.max("last").over(by.rowsBetween(W.unboundedPreceding, -3))
    carried = F.greatest(older, F.lag("early2", 2).over(by), F.lag("early1", 1).over(by))["value"]
    return all_ends.select(*KEYS, "_bucket", *[carried.alias(f"_carry_{s.name}") for s in lookbacks])
