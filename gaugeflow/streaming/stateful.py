"""Rolling features kept in streaming state.

State is keyed by asset, because a rule may mix sensors of one asset, or by (asset, sensor) when
no rule does. Rows wait in parcels until the watermark has passed them, a timer calls them up, and
they are then taken in order of (ts, seq), so a stream gives the batch answer however its rows
arrive within the watermark. Later rows are dropped by Spark and counted in its progress report.

State is a map of small pages in RocksDB: a batch reads and writes the pages it touches, and the
cost of a reading does not grow with the windows (see ``operators.sliding``). Per sensor the state
holds the samples the longest window reaches back to, not more.

One key's rows are handled by one task, as state demands; for a stream in which one asset
dominates, ``microbatch`` spreads a batch over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeflow.model import CheckerConfig, Requirement, Rule
from gaugeflow.operators import sliding
from gaugeflow.operators.rules import RowStatus, events, fired
from gaugeflow.operators.windows import ZERO_START, Series, resolve
from gaugeflow.sources.readings import LATER

BEAT = "asset string, sensor_id string, ts timestamp, ts_us bigint, seq bigint, value double"
PAGE_KEY, PAGE = "sensor string, name string, page bigint", "numbers array<double>"
PARCEL_KEY, PARCEL = "number bigint", "ts array<bigint>, seq array<bigint>, sensor array<string>, value array<double>"
DUE = "due bigint, parcels array<bigint>, earliest array<bigint>"
# Rows that wait together; a parcel is read once the watermark has reached its first row.
PARCEL_ROWS = 4096
# Rows of a key that are sorted, or answered, at a time.
RUN_ROWS = 64 * PARCEL_ROWS
# Set where the session names no other: the state API needs this store, and a log of changes instead of whole snapshots.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class _Sensor:
    """The samples of one sensor and the series over them, in pages."""

    def __init__(self, pages: sliding.Pages, series: Sequence[Series], config: CheckerConfig):
        self.pages, self.series, self.config = pages, series, config
        self.reach = max([s.start for s in series] + [1])
        self.seen = int((pages.get(("n", 0)) or [0])[0])

    def advance(self, now: np.ndarray) -> list[np.ndarray]:
        """Each series at moments with the current values ``now`` (NaN: none), which follow what was seen."""
        new = ~np.isnan(now)
        values, before = now[new], self.seen
        seen = before + np.cumsum(new)
        samples = sliding.Row(self.pages, "v")
        if len(values):
            samples.append(before, values)
        out = [self._at(i, s, samples, values, before, seen, now) for i, s in enumerate(self.series)]
        if len(values):
            self.seen = before + len(values)
            self.pages.put(("n", 0), [float(self.seen)])
            samples.forget(self.seen - self.reach - 1, before - self.reach - 1 - sliding.PAGE)
        return out

    def _at(self, i: int, s: Series, samples: sliding.Row, values: np.ndarray, before: int, seen: np.ndarray, now: np.ndarray) -> np.ndarray:
        if s.kind == "current":
            return now
        out = np.full(len(now), np.nan)
        if s.kind == "empty":
            return out
        place = seen - 1 - s.end
        known = place >= 0
        if s.kind == "lookback":
            source = samples
        else:
            known &= seen >= self.config.min_samples + s.end
            source = sliding.Row(self.pages, f"a{i}")
            if len(values):
                width = s.start - s.end
                source.append(before, sliding.window(self.pages, f"w{i}", width, s.statistic, self.config.quantile).extend(samples, before, values))
        if known.any():
            first = int(place[known].min())
            out[known] = source.slice(first, int(place[known].max()) + 1)[place[known] - first, 0]
        if s.kind == "window" and len(values):
            source.forget(before + len(values) - s.end - 1, before - s.end - 1 - sliding.PAGE)
        if s.kind == "window" and (s.statistic == "count" or (self.config.warmup == "zero" and s.statistic in ZERO_START)):
            early = self.config.min_samples > 1 and seen < self.config.min_samples + s.end
            return np.where(early, np.nan, np.nan_to_num(out))
        return out


class _Rolling(StatefulProcessor):
    """Rows in, moments with their features out once the watermark has passed them."""

    def __init__(self, plan: list[tuple[str, str, Series]], keys: list[str], config: CheckerConfig, run_rows: int):
        self.plan, self.keys, self.config, self.run_rows = plan, keys, config, run_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", PAGE_KEY, PAGE)
        self.waiting = handle.getMapState("waiting", PARCEL_KEY, PARCEL)
        self.due = handle.getValueState("due", DUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, parcels = self._due()
        held, size = [], 0
        for some in rows:
            held.append(some[["ts_us", "seq", "sensor_id", "value"]])
            size += len(some)
            if size >= self.run_rows:
                self._wait(pd.concat(held, ignore_index=True).sort_values("ts_us", kind="stable"), parcels)
                held, size = [], 0
        if size:
            self._wait(pd.concat(held, ignore_index=True).sort_values("ts_us", kind="stable"), parcels)
        self._call(due, parcels)
        return iter(())

    def _due(self) -> tuple[int | None, dict[int, int]]:
        """The timer that is set, and the earliest time in each parcel of waiting rows."""
        if not self.due.exists():
            return None, {}
        due, parcels, earliest = self.due.get()
        return due, dict(zip(parcels, earliest))

    def _wait(self, rows: pd.DataFrame, parcels: dict[int, int]) -> None:
        """Rows in order of time, laid by in new parcels of neighbours, which are added to ``parcels``."""
        number = max(parcels, default=-1) + 1
        for a in range(0, len(rows), PARCEL_ROWS):
            some = rows.iloc[a : a + PARCEL_ROWS]
            columns = some["ts_us"].astype("int64").tolist(), some["seq"].astype("int64").tolist(), some["sensor_id"].tolist(), some["value"].astype(float).tolist()
            self.waiting.updateValue((number,), columns)
            parcels[number] = columns[0][0]
            number += 1

    def _call(self, before: int | None, parcels: dict[int, int]) -> None:
        """One timer: that of the earliest waiting row."""
        due = min(parcels.values()) // 1000 + 1 if parcels else None
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is None:
            self.due.clear()
            return
        if before != due:
            self.handle.registerTimer(due)
        self.due.update((due, list(parcels), list(parcels.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        _, parcels = self._due()
        come = sorted((earliest, number) for number, earliest in parcels.items() if earliest <= passed)
        held, fresh = [], 0
        for (_, number), (after, _) in zip(come, [*come[1:], (passed + 1, 0)]):
            held.append(pd.DataFrame(dict(zip(("ts_us", "seq", "sensor_id", "value"), map(list, self.waiting.getValue((number,)))))))
            fresh += len(held[-1])
            self.waiting.removeKey((number,))
            del parcels[number]
            if fresh < self.run_rows and number != come[-1][1]:
                continue
            rows = pd.concat(held, ignore_index=True)
            now = rows["ts_us"] < after  # what is earlier than the next parcel is all there; the rest meets its neighbours
            held, fresh = [rows[~now]], 0
            if now.any():
                yield self._answer(key, rows[now].reset_index(drop=True))
        if sum(map(len, held)):
            self._wait(pd.concat(held, ignore_index=True).sort_values("ts_us", kind="stable"), parcels)
        self._call(None, parcels)  # the timer that has come is gone by itself

    def _answer(self, key, ready: pd.DataFrame) -> pd.DataFrame:
        ready["value"] = ready["value"].astype(float)
        ready = ready.sort_values(["sensor_id", "ts_us", "value"], kind="stable", na_position="first")
        later = ready["seq"] == LATER
        ready.loc[later, "seq"] = ready[later].groupby(["sensor_id", "ts_us"], dropna=False).cumcount()
        moments = ready[["ts_us", "seq"]].drop_duplicates().sort_values(["ts_us", "seq"], kind="stable", ignore_index=True)
        place = pd.MultiIndex.from_frame(moments)
        arrived: dict[str, np.ndarray] = {}
        for sensor, own in ready.groupby("sensor_id", sort=False):
            arrived[sensor] = np.full(len(moments), np.nan)
            arrived[sensor][place.get_indexer(pd.MultiIndex.from_frame(own[["ts_us", "seq"]]))] = own["value"].to_numpy()
        none = np.full(len(moments), np.nan)
        columns = {}
        named = {sensor: [p for p in self.plan if len(self.keys) > 1 or p[1] == sensor] for sensor in ([key[1]] if len(self.keys) > 1 else {p[1] for p in self.plan})}
        for sensor, plan in named.items():
            pages = sliding.Pages(lambda k, sensor=sensor: self._read(sensor, k))
            told = _Sensor(pages, [s for _, _, s in plan], self.config).advance(arrived.get(sensor, none))
            columns |= {name: answer for (name, _, _), answer in zip(plan, told)}
            for (name, page), numbers in pages.changes():
                if numbers is None:
                    self.pages.removeKey((sensor, name, page))
                else:
                    self.pages.updateValue((sensor, name, page), (numbers,))
        head = {k: [v] * len(moments) for k, v in zip(self.keys, key)}
        return pd.DataFrame({**head, **moments.astype("int64"), **{name: columns[name] for name, _, _ in self.plan}})

    def _read(self, sensor: str, key: sliding.Key) -> list[float] | None:
        found = self.pages.getValue((sensor, *key))
        return None if found is None else list(found[0])

    def close(self) -> None:
        pass


def status_stream(
    readings: DataFrame,
    requirements: Sequence[Requirement],
    config: CheckerConfig = CheckerConfig(),
    delay: str = "10 minutes",
    by_sensor: bool = False,
) -> DataFrame:
    """Append-only stream of moments with one column per requirement.

    ``readings`` is the canonical long shape with ``event_time`` a timestamp. With ``by_sensor``
    state is kept per (asset, sensor), and columns are series of the row's own sensor. State counts
    samples; windows by the clock need ``microbatch``. Readings without a seq are numbered by value
    when the watermark has passed their instant, as in batch. Where the session names no state
    store, STORE is set in it.
    """
    if config.mode != "samples":
        raise ValueError("state is kept in samples; use microbatch for windows by the clock")
    spark = readings.sparkSession
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        for name, value in STORE.items():
            spark.conf.set(name, value)
    keys = ["asset", "sensor_id"] if by_sensor else ["asset"]
    plan = {(r.series if by_sensor else r.name): (r.sensor_id, resolve(r, config)) for r in requirements}
    plan = [(name, sensor, series) for name, (sensor, series) in plan.items()]
    schema = ", ".join([f"{k} string" for k in keys] + ["ts_us bigint", "seq bigint"] + [f"`{name}` double" for name, _, _ in plan])
    grouped = readings.withWatermark("event_time", delay).groupBy(*keys)
    out = grouped.transformWithStateInPandas(_Rolling(plan, keys, config, RUN_ROWS), schema, "append", "eventtime")
    nulled = {name: F.nanvl(F.col(f"`{name}`"), F.lit(None).cast("double")) for name, _, _ in plan}
    return out.withColumns(nulled).withColumn("ts", F.timestamp_micros("ts_us"))


def rule_stream(
    readings: DataFrame, rules: Sequence[Rule], config: CheckerConfig = CheckerConfig(), delay: str = "10 minutes", align: bool = True
) -> DataFrame:
    """Append-only stream of the events of rules, without sensor values: those are known when all of a moment is there.

    Rules are decided at every moment of an asset. With ``align=False`` rules on one sensor are decided on that sensor's
    rows alone, and if all are, state is kept per (asset, sensor).
    """
    compiled = [(rule, *rule.compile()) for rule in rules]
    asked = list(dict.fromkeys(r for _, _, reqs in compiled for r in reqs))
    alone = not align and all(len({r.sensor_id for r in reqs}) == 1 for _, _, reqs in compiled)
    status = status_stream(timed(readings), asked, config, delay, by_sensor=alone)
    if alone:
        return events(fired(status, [(rule, (F.col("sensor_id") == reqs[0].sensor_id) & rule.when(RowStatus())) for rule, _, reqs in compiled]))
    return events(fired(status, [(rule, predicate) for rule, predicate, _ in compiled]))


def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the readings that ``close`` puts into ``folder``: union it with the readings of a stream that will end."""
    spark.createDataFrame([], BEAT).coalesce(1).write.mode("append").parquet(folder)  # the folder must be there
    return spark.readStream.schema(BEAT).parquet(folder)


def close(spark: SparkSession, folder: str, asset: str = "", at_us: int = 4_000_000_000_000_000) -> None:
    """Let the watermark pass everything: one reading of no sensor, far in the future, which itself is never answered.

    Without it the rows of the last ``delay`` of a stream that ends stay in state for ever.
    """
    row = [(asset, "", at_us, 0, None)]
    beat = spark.createDataFrame(row, "asset string, sensor_id string, ts_us bigint, seq bigint, value double")
    beat.select("asset", "sensor_id", F.timestamp_micros("ts_us").alias("ts"), "ts_us", "seq", "value").coalesce(1).write.mode("append").parquet(folder)


def timed(readings: DataFrame) -> DataFrame:
    """Canonical readings with the timestamp column a watermark needs."""
    return readings.withColumn("event_time", F.timestamp_micros("ts_us"))
