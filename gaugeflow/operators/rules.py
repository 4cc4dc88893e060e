"""Rules over features: predicates, rule rows and Python functions, all giving an event table.

Events: asset, timestamp, seq, rule_name, triggered, result, sensor_values, explanation,
rule_description.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.model import CheckerConfig, Requirement, Rule, RuleFunction, Status
from gaugeflow.operators import layout, ruleindex, ruletrace, windows
from gaugeflow.sources import readings as rd

log = logging.getLogger(__name__)

MOMENT = ["asset", "ts", "ts_us", "seq"]
# Rules evaluated in one array; longer ones make the generated code too long to compile.
RULES_PER_PROJECTION = 100
EVENT = ["asset", "timestamp", "seq", "rule_name", "triggered", "result", "sensor_values", "explanation", "rule_description"]


def truthy(value: Column, guard: str = "nonzero") -> Column:
    """The ``if x`` guard: neither null nor zero. ``guard="not_null"`` lets zero through."""
    return value.isNotNull() if guard == "not_null" else value.isNotNull() & (value != 0)


def assemble(features: DataFrame, requirements: Sequence[Requirement]) -> DataFrame:
    """One row per moment with one column per requirement, from features that are still rows."""
    used = sorted({r.sensor_id for r in requirements})
    have = set(features.columns)
    picks = [
        F.max(F.when(F.col("sensor_id") == r.sensor_id, F.col(f"`{r.series}`"))).alias(r.name)
        for r in requirements
        if r.series in have
    ]
    absent = [F.lit(None).cast("double").alias(r.name) for r in requirements if r.series not in have]
    wide = features.where(F.col("sensor_id").isin(used)).groupBy(*MOMENT).agg(*picks) if picks else features.select(*MOMENT).distinct()
    return wide.select("*", *absent)


def status_table(
    readings: DataFrame, requirements: Sequence[Requirement], config: CheckerConfig = CheckerConfig(), align: bool = True
) -> DataFrame:
    """Every requirement of every moment, side by side."""
    return assemble(_features(readings, requirements, config, align), requirements)


def _features(readings: DataFrame, requirements: Sequence[Requirement], config: CheckerConfig, align: bool) -> DataFrame:
    """Features of the sensors the requirements name, with a row per sensor and moment if aligned."""
    sensors = sorted({r.sensor_id for r in requirements})
    if not align:
        return windows.features(readings.where(F.col("sensor_id").isin(sensors)), requirements, config)
    return windows.features(rd.aligned(readings, sensors), requirements, config, (readings, len(sensors)))


def fired(table: DataFrame, compiled: list[tuple[Rule, Column]]) -> DataFrame:
    """Rules whose predicate is true, one row each; a null predicate is no event."""
    arrays = []
    for start in range(0, len(compiled), RULES_PER_PROJECTION):
        hits = F.array(
            *[
                F.when(
                    predicate,
                    F.struct(
                        F.lit(rule.name).alias("rule_name"),
                        F.lit(rule.result).alias("result"),
                        F.lit(rule.description).alias("rule_description"),
                    ),
                )
                for rule, predicate in compiled[start : start + RULES_PER_PROJECTION]
            ]
        )
        arrays.append(F.filter(hits, lambda hit: hit.isNotNull()))
    return table.select(*MOMENT, F.inline(F.concat(*arrays)))


def _no_hits(readings: DataFrame) -> DataFrame:
    return readings.limit(0).select(*MOMENT, *[F.lit("").alias(c) for c in ("rule_name", "result", "rule_description")])


def check(
    readings: DataFrame,
    rules: Sequence[Rule | RuleFunction],
    config: CheckerConfig = CheckerConfig(),
    align: bool = True,
    snapshot: bool = True,
) -> DataFrame:
    """Events of all rules over all readings. However many rules there are, features are computed once per branch
    (rules on one sensor, rules on several); no rules give no events."""
    if not rules:
        return events(_no_hits(readings))
    plain = [(rule, *rule.compile()) for rule in rules if isinstance(rule, Rule)]
    functions = [rule for rule in rules if isinstance(rule, RuleFunction)]
    needed = list(
        dict.fromkeys([r for _, _, reqs in plain for r in reqs] + [r for rule in functions for r in rule.requirements])
    )
    features = _features(readings, needed, config, align)

    parts = []
    # A rule on one sensor is decided on that sensor's rows; only mixed rules pay the second shuffle.
    alone: dict[str, list[tuple[Rule, Column]]] = {}
    mixed: list[tuple[Rule, Column]] = []
    mixed_needs: dict[Requirement, None] = {}
    for rule, predicate, reqs in plain:
        used = {r.sensor_id for r in reqs}
        if len(used) == 1:
            alone.setdefault(used.pop(), []).append((rule, reqs))
        else:
            mixed.append((rule, predicate))
            mixed_needs.update(dict.fromkeys(reqs))
    if alone:
        parts.append(fired(features, [(rule, (F.col("sensor_id") == s) & rule.when(RowStatus())) for s, group in alone.items() for rule, _ in group]))
    for rule in functions:
        mixed_needs.update(dict.fromkeys(rule.requirements))
    if mixed or functions:
        table = assemble(features, list(mixed_needs))
        if mixed:
            parts.append(fired(table, mixed))
        if functions:
            parts.append(_called(table, functions, config).where("error is null").drop("error"))
    return events(reduce(DataFrame.unionByName, parts), readings if snapshot else None)


class RowStatus(Status):
    """Status whose columns are the series of the row's own sensor."""

    def get(self, sensor_id: str, time_expression: str, statistic: str | None = None) -> Column:
        return F.col(f"`{Requirement(sensor_id, time_expression, statistic).series}`")


def events(fired: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """The event table; sensor values are looked up for moments with an event only.

    Hits are gathered per moment before the lookup, so the features behind them run once and the
    lookup and the map share one shuffle.
    """
    moment = ["asset", "ts_us", "seq"]
    shown = F.lit(None).cast("map<string,double>")
    if readings is not None:
        hit = F.struct("ts", "rule_name", "result", "rule_description")
        hits = fired.groupBy(*moment).agg(F.collect_list(hit).alias("hits"))
        values = readings.where("value is not null").select(*moment, F.struct("sensor_id", "value").alias("entry"))
        fired = (
            hits.join(values, moment, "left")
            .groupBy(*moment)
            .agg(F.first("hits").alias("hits"), F.map_from_entries(F.array_sort(F.collect_list("entry"))).alias("sensor_values"))
            .select("asset", "seq", "sensor_values", F.inline("hits"))
        )
        shown = F.col("sensor_values")
    return fired.select(
        "asset",
        F.col("ts").alias("timestamp"),
        "seq",
        "rule_name",
        F.lit(True).alias("triggered"),
        "result",
        shown.alias("sensor_values"),
        explanation(F.col("rule_name"), F.col("result")).alias("explanation"),
        "rule_description",
    )


def explanation(name: Column, result: Column) -> Column:
    return F.concat(F.lit("Rule '"), name, F.lit("' returned: "), result)


def snapshots(readings: DataFrame) -> DataFrame:
    """Map of the non-null values at each moment."""
    return readings.groupBy(*MOMENT).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("sensor_id", "value"))))
        ).alias("sensor_values")
    )


def rule_errors(table: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Strict mode: moments where a rule could not be decided because a feature is missing."""
    arrays = []
    for start in range(0, len(rules), RULES_PER_PROJECTION):
        entries = []
        for rule in rules[start : start + RULES_PER_PROJECTION]:
            predicate, reqs = rule.compile()
            missing = F.filter(
                F.array(*[F.when(F.col(f"`{r.name}`").isNull(), F.lit(r.name)) for r in reqs]), lambda m: m.isNotNull()
            )
            entries.append(F.when(predicate.isNull(), F.struct(F.lit(rule.name).alias("rule_name"), missing.alias("missing"))))
        arrays.append(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    return table.select(*MOMENT, F.inline(F.concat(*arrays)))


class _FunctionStatus:
    """What a rule function sees: the features of one moment."""

    def __init__(self) -> None:
        self.row: dict = {}

    def get(self, sensor_id: str, time_expression: str, statistic: str | None = None) -> float | None:
        return self.row.get(Requirement(sensor_id, time_expression, statistic).name)


def _called(table: DataFrame, rules: Sequence[RuleFunction], config: CheckerConfig) -> DataFrame:
    """What rule functions say of every moment; anything but None is an event.

    Functions that can be traced become expressions, the others run over Arrow batches of moments.
    """
    names = list(dict.fromkeys(r.name for rule in rules for r in rule.requirements))
    trees = [(rule, ruletrace.traced(rule.fn, names)) for rule in rules]
    parts, told = [], [(rule, tree) for rule, tree in trees if tree is not None]
    if told:
        arrays, group, size = [], [], 0
        for rule, tree in told:
            group.append(ruletrace.outcome(tree, rule.name, rule.description))
            size += ruletrace.leaves(tree)
            if size >= RULES_PER_PROJECTION or rule is told[-1][0]:
                arrays.append(F.filter(F.array(*group), lambda said: said.isNotNull()))
                group, size = [], 0
        parts.append(table.select(*MOMENT, F.inline(F.concat(*arrays))))
    rest = [rule for rule, tree in trees if tree is None]
    if rest:
        parts.append(_run(table, rest, names))
    return reduce(DataFrame.unionByName, parts)


def _run(table: DataFrame, rules: Sequence[RuleFunction], names: list[str]) -> DataFrame:
    """Rule functions as they are, over Arrow batches of moments."""
    calls = [(rule.name, rule.description, rule.fn) for rule in rules]
    moment = table.select(*MOMENT, *[f"`{n}`" for n in names])
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moment.schema.fields if f.name in MOMENT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        status = _FunctionStatus()
        for batch in batches:
            values = batch[names].astype(object).where(batch[names].notna(), None)
            out = []
            for place, row in enumerate(values.to_dict("records")):
                status.row = row
                for name, description, fn in calls:
                    try:
                        result, error = fn(status), None
                    except Exception as problem:  # a rule that fails must not stop the others
                        result, error = None, f"{type(problem).__name__}: {problem}"
                    if result is not None or error is not None:
                        out.append((place, name, None if result is None else str(result), description, error))
            found = pd.DataFrame(out, columns=["place", "rule_name", "result", "rule_description", "error"])
            moments = batch[MOMENT].iloc[found["place"]].reset_index(drop=True)
            yield pd.concat([moments, found.drop(columns="place")], axis=1)

    schema = head + ", rule_name string, result string, rule_description string, error string"
    return moment.mapInPandas(run, schema)


def function_errors(table: DataFrame, rules: Sequence[RuleFunction], config: CheckerConfig = CheckerConfig()) -> DataFrame:
    """Strict mode for rule functions: what each of them raised, and when."""
    return _called(table, rules, config).where("error is not null").drop("result")


# Rules held as rows: rule_id, rule_name, sensor_id, time_expression, statistic, op, threshold, result.
# The rows of one rule_id must all hold.

# Conditions from which matching costs more than spreading the rows evenly over all cores first.
MANY_CONDITIONS = 2_000


def check_rows(
    readings: DataFrame,
    rule_rows: DataFrame,
    config: CheckerConfig = CheckerConfig(),
    align: bool = True,
    guard: str = "nonzero",
    snapshot: bool = True,
) -> DataFrame:
    """Events of rules held as rows: the plan does not grow with the number of rules.

    Rules on one sensor are matched on that sensor's rows; only the distinct (expression, statistic)
    of theirs come to the driver, and name the window columns. Rules on several sensors need the
    features of a moment side by side, one column per distinct (sensor, expression, statistic) that
    such rules use. ``ruleindex`` matches their thresholds, so rows of the plan are events, never
    pairs of a row and a rule that does not fire. A condition without a sensor, expression,
    comparison or threshold never holds. No rules give no events.
    """
    spark = readings.sparkSession
    series = F.concat("time_expression", F.coalesce(F.concat(F.lit("@"), "statistic"), F.lit("")))
    sensor = F.coalesce("sensor_id", F.lit(""))
    condition = F.struct(sensor.alias("sensor"), "time_expression", "statistic", series.alias("series"), ruleindex.operator_number(F.col("op")).alias("op"), "threshold")
    rules = rule_rows.groupBy("rule_id").agg(
        F.max("rule_name").alias("rule_name"),
        F.max("result").alias("result"),
        (F.min(sensor) != F.max(sensor)).alias("mixed"),
        F.collect_list(condition).alias("conditions"),
    )
    conditions = rules.select("rule_id", "rule_name", "result", "mixed", F.inline("conditions"))
    asked = conditions.groupBy("mixed", F.when(F.col("mixed"), F.col("sensor")).alias("sensor"), "time_expression", "statistic").agg(F.count(F.lit(1)).alias("count")).collect()
    if not asked:
        return events(_no_hits(readings))

    parts = []
    for mixed in sorted({row["mixed"] for row in asked}):
        kind = [row for row in asked if row["mixed"] == mixed]
        own, total = conditions.where(F.col("mixed") == mixed), sum(row["count"] for row in kind)
        reqs = [Requirement(row["sensor"] or "", row["time_expression"], row["statistic"]) for row in kind if row["time_expression"] is not None]
        if mixed:
            table = assemble(_features(readings, reqs, config, align), reqs)
            names, key = [r.name for r in reqs], F.concat("sensor", F.lit("|"), "series")
        else:
            sensors = own.select(F.col("sensor").alias("sensor_id")).distinct()
            table = windows.features(readings.join(layout.small(sensors), "sensor_id", "left_semi"), reqs, config)
            names, key = list(dict.fromkeys(r.series for r in reqs)), F.col("series")
        if total > MANY_CONDITIONS:
            table = table.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        told = own.select("rule_id", "rule_name", "result", (F.lit("") if mixed else F.col("sensor")).alias("sensor"), key.alias("feature"), "op", "threshold")
        parts.append(ruleindex.fired(table, MOMENT, names, told, total, guard, None if mixed else "sensor_id", ("rule_name", "result")))
    hits = reduce(DataFrame.unionByName, parts).select(*MOMENT, "rule_name", "result", F.lit("").alias("rule_description"))
    return events(hits, readings if snapshot else None)


def from_rule_table(loaded: DataFrame, registry: dict[str, RuleFunction]) -> list[RuleFunction]:
    """Functions registered under the names of catalogued rules; rule text is never executed.

    Only names that are registered come to the driver, so the registry bounds what is collected.
    """
    registered = F.col("rule_name").isin(list(registry)) if registry else F.lit(False)
    names = {row[0] for row in loaded.where(registered).select("rule_name").distinct().collect()}
    missing = loaded.where(~F.coalesce(registered, F.lit(False))).select("rule_name").distinct().count()
    if missing:
        log.warning("no function registered for %d rules", missing)
    return [registry[name] for name in sorted(names)]


def run_statistics(readings: DataFrame, event_table: DataFrame, num_rules: int, config: CheckerConfig = CheckerConfig()) -> DataFrame:
    """One row: rules, granularity, sensors seen, events."""
    sensors = readings.agg(F.count_distinct("sensor_id").alias("num_sensors_tracked"))
    count = event_table.agg(F.count(F.lit(1)).alias("total_events"))
    both = sensors.unionByName(count, allowMissingColumns=True)
    return both.agg(
        F.lit(num_rules).alias("num_rules"),
        F.lit(config.granularity).alias("granularity"),
        F.max("num_sensors_tracked").alias("num_sensors_tracked"),
        F.max("total_events").alias("total_events"),
    )


def events_per_rule(event_table: DataFrame) -> DataFrame:
    return event_table.groupBy("rule_name").agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), "rule_name")


def named(event_table: DataFrame, part: str) -> DataFrame:
    """Events whose rule name contains a text."""
    return event_table.where(F.col("rule_name").contains(part))


def readings_at(event_table: DataFrame, readings: DataFrame, sensor_id: str) -> DataFrame:
    """The reading of a sensor at the time of each event."""
    at = readings.where(F.col("sensor_id") == sensor_id).select("asset", F.col("ts").alias("timestamp"), "seq", "value")
    return event_table.join(at, ["asset", "timestamp", "seq"])
