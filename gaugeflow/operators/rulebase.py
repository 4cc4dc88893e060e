"""Tables of candidate rules: parse, check, resolve names and times, verify.

A rule table has rule_id, rule_name and rule_body. Everything a rule needs is in its own text, so
collecting the calls of one rule is bounded by that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions import rulecalls, timeexpr
from gaugeflow.model import VERIFIED_STATISTICS
from gaugeflow.operators import layout

# The fence around a JSON answer.
FENCE = r"(?s)```(?:json)?\s*\n(.*?)\n```"
RULE_FIELDS = ["rule_name", "rule_description", "rule_reasoning", "rule_source", "rule_body", "rule_type"]
REQUIRED_FIELDS = RULE_FIELDS[:-1]


def parse_answers(answers: DataFrame, answer: str = "answer", keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """One row per rule of each JSON answer, with ``error`` null, or saying what is wrong.

    An answer that is not one JSON value and nothing else is one row with error ``json``; one that
    is no object, or whose ``rules`` are no list (a null included), one row with error ``rules``. An
    answer without the key, or with an empty list, has no row. A rule that is no object, or has a
    field of another type than text, is a row with error ``types``; fields that are missing or null
    are null here and left to ``check_schema``.
    """
    text = F.trim(F.col(answer))
    inner = F.regexp_extract(text, FENCE, 1)
    body = F.when(text.contains("```") & (inner != ""), inner).otherwise(text)
    # Within brackets, text after the value can't be overlooked: it breaks the list or makes it longer.
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    got = lambda value, path, kind="variant": F.try_variant_get(value, path, kind)
    read = answers.select(*keys, whole.alias("whole")).select(*keys, "whole", got(F.col("whole"), "$[0]").alias("root"))
    listed = F.schema_of_variant(got(F.col("root"), "$.rules"))
    error = (
        F.when(F.col("root").isNull() | got(F.col("whole"), "$[1]").isNotNull(), F.lit("json"))
        .when(~F.schema_of_variant("root").startswith("OBJECT"), F.lit("rules"))
        .when(listed.isNotNull() & ~listed.startswith("ARRAY"), F.lit("rules"))
    )
    rows = read.select(*keys, error.alias("error"), "root").select(
        *keys, "error", F.posexplode_outer(F.when(F.col("error").isNull(), got(F.col("root"), "$.rules", "array<variant>"))).alias("rule_idx", "rule")
    )
    # the object is taken apart once, by its keys; what is no object has no keys and is told apart by that
    rows = rows.where("rule_idx is not null or error is not null").withColumn("rule", got(F.col("rule"), "$", "map<string,variant>"))
    rows = rows.withColumns({f"_{f}": F.try_element_at("rule", F.lit(f)) for f in RULE_FIELDS}).withColumns({f"_kind_{f}": F.schema_of_variant(f"_{f}") for f in RULE_FIELDS})
    wrong = F.col("rule").isNull()
    for f in RULE_FIELDS:
        wrong = wrong | F.coalesce(~F.col(f"_kind_{f}").isin("STRING", "VOID"), F.lit(False))
    fields = [F.when(F.col(f"_kind_{f}") == "STRING", got(F.col(f"_{f}"), "$", "string")).alias(f) for f in RULE_FIELDS]
    return rows.select(
        *keys, "rule_idx", *fields, F.coalesce("error", F.when(F.col("rule_idx").isNotNull() & F.coalesce(wrong, F.lit(True)), F.lit("types"))).alias("error")
    )


def schema_errors(name: Column, body: Column, required: tuple[str, ...] = ()) -> Column:
    """Texts of the checks a rule fails; empty when it passes all."""
    bare = F.replace(name, F.lit("_"), F.lit(""))
    checks = [(F.col(field).isNull(), f"{field} is required") for field in required]
    checks += [
        (~F.coalesce(bare.rlike(r"^[\p{L}\p{N}]+$"), F.lit(False)), "rule_name must be alphanumeric snake_case"),
        (F.coalesce(name != F.lower(name), F.lit(False)), "rule_name must be lowercase"),
        (~F.coalesce(body.contains("def "), F.lit(False)), "rule_body must define a function"),
        (~F.coalesce(body.contains("status.get("), F.lit(False)), "rule_body must call status.get()"),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda e: e.isNotNull())


def checked(rules: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """Every rule with its ``errors``, none for one that is valid; each is read once.

    All fields but rule_type are required, as far as the table has them. A row that ``parse_answers``
    gave an error is rejected for it. With ``per``, one bad rule takes all rules of the same answer
    with it, as when an answer is only accepted whole: ``per=("task_id",)``.
    """
    required = tuple(f for f in REQUIRED_FIELDS if f in rules.columns)
    errors = schema_errors(F.col("rule_name"), F.col("rule_body"), required)
    if "error" in rules.columns:
        errors = F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("answer: "), "error"))).otherwise(errors)
    told = rules.withColumn("errors", errors)
    if per:
        bad = told.where(F.size("errors") > 0).select(*per).distinct().withColumn("_bad", F.lit(True))
        beside = F.array(F.lit("another rule of the answer is rejected"))
        told = told.join(bad, list(per), "left").withColumn(
            "errors", F.when(F.col("_bad") & (F.size("errors") == 0), beside).otherwise(F.col("errors"))
        ).drop("_bad")
    return told


def check_schema(rules: DataFrame, per: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rules of ``checked``; rejected ones carry ``errors``, and every rule is in one of the two."""
    told = checked(rules, per)
    return told.where(F.size("errors") == 0).drop("errors"), told.where(F.size("errors") > 0)


def resolve_sensors(rules: DataFrame, mappings: DataFrame, sensors: DataFrame | None = None) -> DataFrame:
    """Put sensor ids in place of quoted descriptions, in call order; keeps the body as it was.

    ``mappings``: rule_id, sensor_description, sensor_id (null: not found). With ``sensors``, a
    collection without any sensor leaves all its rules unresolved.
    """
    described = rules.select("rule_id", F.posexplode(rulecalls.call_sensors(F.col("rule_body"))).alias("idx", "sensor_description"))
    first = described.groupBy("rule_id", "sensor_description").agg(F.min("idx").alias("idx"))
    found = first.join(mappings, ["rule_id", "sensor_description"], "left")
    steps = found.groupBy("rule_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "sensor_description", "sensor_id"))).alias("steps"),
        F.count_if(F.col("sensor_id").isNull() | (F.col("sensor_id") == "")).alias("unmapped"),
    )

    def put(body: Column, step: Column) -> Column:
        known = step["sensor_id"].isNotNull() & (step["sensor_id"] != "")
        double = F.replace(body, F.concat(F.lit('"'), step["sensor_description"], F.lit('"')), F.concat(F.lit('"'), step["sensor_id"], F.lit('"')))
        both = F.replace(double, F.concat(F.lit("'"), step["sensor_description"], F.lit("'")), F.concat(F.lit("'"), step["sensor_id"], F.lit("'")))
        return F.when(known, both).otherwise(body)

    joined = rules.join(steps, "rule_id", "left").withColumn("rule_body_original", F.col("rule_body"))
    body = F.when(F.col("steps").isNull(), F.col("rule_body")).otherwise(F.aggregate("steps", F.col("rule_body"), put))
    status = F.when(F.col("steps").isNull(), F.lit("no_sensors")).when(F.col("unmapped") > 0, F.lit("sensors_not_found")).otherwise(F.lit("ok"))
    if sensors is not None:
        stocked = layout.small(sensors.select("collection_id").distinct().withColumn("stocked", F.lit(True)))
        joined = joined.join(stocked, "collection_id", "left")
        without = F.col("stocked").isNull()
        body = F.when(without, F.col("rule_body")).otherwise(body)
        status = F.when(without, F.lit("sensors_not_found")).otherwise(status)
    return joined.withColumns({"rule_body": body, "sensor_parsing_status": status}).drop("steps", "unmapped", "stocked")


def resolve_times(rules: DataFrame, mappings: DataFrame) -> DataFrame:
    """Put time expressions in place of descriptions, call by call.

    ``mappings``: time_description, time_expression, time_statistic. A call with no usable
    mapping stays as it is and turns the status into parse_error.
    """
    found = rules.select("rule_id", F.posexplode(rulecalls.call_arguments(F.col("rule_body"))).alias("idx", "arguments"))
    args = rulecalls.quoted(F.col("arguments"))
    found = found.select(
        "rule_id", "idx", "arguments", F.get(args, F.lit(0)).alias("sensor"), F.get(args, F.lit(1)).alias("time_description")
    )
    # A common description may be a third of all calls: the dictionary is broadcast when it is
    # small, and otherwise adaptive execution splits the description.
    known = found.join(layout.small(mappings), "time_description", "left").withColumn(
        "parsed", timeexpr.interval(F.col("time_expression"))
    )
    parsed = F.col("parsed")
    statistic = F.nullif(F.col("time_statistic"), F.lit(""))
    new_call = F.when(
        parsed["is_interval"],
        F.when(
            statistic.isNotNull(),
            F.concat(F.lit('status.get("'), "sensor", F.lit('", "'), "time_expression", F.lit('", "'), statistic, F.lit('")')),
        ),
    ).when(parsed.isNotNull(), F.concat(F.lit('status.get("'), "sensor", F.lit('", "'), "time_expression", F.lit('")')))
    steps = (
        known.select("rule_id", "idx", F.concat(F.lit("status.get("), "arguments", F.lit(")")).alias("old"), new_call.alias("new"))
        .groupBy("rule_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("idx", "old", "new"))).alias("steps"),
            F.count_if(F.col("new").isNull()).alias("failed"),
        )
    )
    body = F.aggregate(
        "steps",
        F.col("rule_body"),
        lambda text, step: F.when(step["new"].isNotNull(), F.replace(text, step["old"], step["new"])).otherwise(text),
    )
    return (
        rules.join(steps, "rule_id", "left")
        .withColumns(
            {
                "rule_body": F.when(F.col("steps").isNull(), F.col("rule_body")).otherwise(body),
                "time_parsing_status": F.when(F.coalesce(F.col("failed"), F.lit(0)) > 0, F.lit("parse_error")).otherwise(F.lit("ok")),
            }
        )
        .drop("steps", "failed")
    )


def verify(rules: DataFrame, sensors: DataFrame, statistics: tuple[str, ...] = VERIFIED_STATISTICS) -> DataFrame:
    """Rules plus ``verification_status``: the first call that fails decides.

    Per call: sensor known, time expression valid, statistic given and listed for an interval,
    none for a point. Sensors are looked up in their collection when both tables name one.
    """
    scope = ["collection_id"] if {"collection_id"} <= set(rules.columns) & set(sensors.columns) else []
    # Every text is parsed once: a rule is its calls, or one row if it has none.
    read = rules.select("rule_id", *scope, rulecalls.analyse("rule_body").alias("read"))
    calls = read.select(
        "rule_id", *scope, F.col("read.syntax_ok").alias("syntax_ok"), F.posexplode_outer("read.calls").alias("call_idx", "call")
    ).select("rule_id", *scope, "syntax_ok", "call_idx", "call.*")
    known = layout.small(sensors.select(*scope, "sensor_id").distinct().withColumn("known", F.lit(True)))
    parsed = F.col("parsed")
    given = F.coalesce(F.col("statistic"), F.lit("")) != ""
    fault = (
        F.when(F.col("call_idx").isNull(), F.lit(None))
        .when(F.col("known").isNull(), F.lit("invalid_sensor"))
        .when(parsed.isNull(), F.lit("invalid_time"))
        .when(parsed["is_interval"] & (~given | ~F.col("statistic").isin(list(statistics))), F.lit("invalid_statistic"))
        .when(~parsed["is_interval"] & given, F.lit("invalid_statistic"))
    )
    verdict = (
        calls.join(known, [*scope, "sensor_id"], "left")
        .withColumn("parsed", timeexpr.interval(F.col("time_expression")))
        .withColumn("fault", fault)
        .groupBy("rule_id")
        .agg(
            F.min(F.when(F.col("fault").isNotNull(), F.struct("call_idx", "fault")))["fault"].alias("fault"),
            F.bool_and("syntax_ok").alias("syntax_ok"),
        )
        .select(
            "rule_id",
            F.when(~F.col("syntax_ok"), F.lit("syntax_error")).otherwise(F.coalesce("fault", F.lit("ok"))).alias("verification_status"),
        )
    )
    return rules.drop("verification_status").join(verdict, "rule_id")
