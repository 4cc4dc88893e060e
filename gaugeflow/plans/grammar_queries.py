"""The time grammar and call extraction (T1-T10), on texts that grow with lineitem and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions import rulecalls, texts, timeexpr
from gaugeflow.operators import layout
from gaugeflow.plans.registry import derived, plain, query

# One expression per order line, over every form the grammar accepts or rejects.
EXPRESSIONS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 14
  WHEN 0 THEN '0'
  WHEN 1 THEN CAST(l_quantity AS INT) || 'm'
  WHEN 2 THEN CAST(l_quantity AS INT) || 'm:'
  WHEN 3 THEN CAST(l_quantity AS INT) || 'h:' || l_linenumber || 'm'
  WHEN 4 THEN CAST(l_quantity AS INT) || 'h' || l_linenumber || 'm'
  WHEN 5 THEN CAST(l_quantity AS INT) * 10 || 'ms'
  WHEN 6 THEN l_linenumber || 'y' || CAST(l_quantity AS INT) || 'd'
  WHEN 7 THEN ''
  WHEN 8 THEN ':' || CAST(l_quantity AS INT) || 'm'
  WHEN 9 THEN 'x' || CAST(l_quantity AS INT) || 'm!'
  WHEN 10 THEN '-' || CAST(l_quantity AS INT) || 'm'
  WHEN 11 THEN l_linenumber || '.5s:' || CAST(l_quantity AS INT) || 's'
  WHEN 12 THEN ' ' || l_linenumber || 'h:' || l_linenumber || 'h '
  ELSE CAST(l_quantity AS INT) || 'us' END AS expr
FROM {lineitem}
"""
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ID_LIST = ", ".join(IDS)
EXPR = f"e AS ({plain(EXPRESSIONS)})"
TERM = r"(\d+(?:\.\d+)?)(us|ms|s|m|h|d|y)"
WHOLE = r"^(\d+(\.\d+)?(us|ms|s|m|h|d|y))+$"


def us_sql(text: str, strict: bool = True, negative: bool = False) -> str:
    """Microseconds of a duration text, as a SQL expression."""
    body = f"trim(CASE WHEN starts_with(trim({text}), '-') THEN substr(trim({text}), 2) ELSE trim({text}) END)"
    terms = (
        f"list_sum(list_transform(list_zip(regexp_extract_all({body}, '{TERM}', 1), regexp_extract_all({body}, '{TERM}', 2)), "
        "lambda z: round(z[1]::DOUBLE * CASE z[2] WHEN 'us' THEN 1 WHEN 'ms' THEN 1000 WHEN 's' THEN 1000000 WHEN 'm' THEN 60000000 "
        "WHEN 'h' THEN 3600000000 WHEN 'd' THEN 86400000000 ELSE 31536000000000 END)))"
    )
    found = f"regexp_matches({body}, '{WHOLE if strict else TERM}')"
    size = f"CASE WHEN {body} IN ('', '0') THEN 0 WHEN {found} THEN CAST({terms} AS BIGINT) END"
    sign = "-1" if negative else "NULL"
    return f"((CASE WHEN starts_with(trim({text}), '-') THEN {sign} ELSE 1 END) * ({size}))"


def parsed_sql(source: str, text: str) -> str:
    """CTE p: the columns of ``source`` with start_us, end_us and is_interval of ``text``, null when invalid."""
    head = f"split_part({text}, ':', 1)"
    tail = f"substr({text}, strpos({text}, ':') + 1)"
    return f"""
  p0 AS (SELECT *, contains({text}, ':') AS has_end, {us_sql(head)} AS s, CASE WHEN contains({text}, ':') THEN {us_sql(tail)} END AS f FROM {source}),
  p1 AS (SELECT *, coalesce(trim({text}) <> '' AND s IS NOT NULL AND (NOT has_end OR (trim({head}) <> '' AND f IS NOT NULL)), false) AS valid FROM p0),
  p AS (SELECT * EXCLUDE (has_end, s, f, valid), CASE WHEN valid THEN s END AS start_us, CASE WHEN valid THEN f END AS end_us,
        CASE WHEN valid THEN has_end END AS is_interval FROM p1)"""


def text_sql(us: str) -> str:
    def part(unit: str, size: int, modulus: int | None) -> str:
        count = f"(abs({us}) // {size})" + (f" % {modulus}" if modulus else "")
        return f"CASE WHEN {count} > 0 THEN ({count}) || '{unit}' ELSE '' END"

    parts = [
        part("y", 31536000000000, None), part("d", 86400000000, 365), part("h", 3600000000, 24), part("m", 60000000, 60),
        part("s", 1000000, 60), part("ms", 1000, 1000), part("us", 1, 1000),
    ]
    return f"CASE WHEN {us} = 0 THEN '0' WHEN {us} IS NOT NULL THEN CASE WHEN {us} < 0 THEN '-' ELSE '' END || {' || '.join(parts)} END"


def expressions(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, EXPRESSIONS, "lineitem")


@query("t01_duration", f"WITH {EXPR} SELECT {ID_LIST}, {us_sql('expr', strict=False, negative=True)} AS us FROM e")
def duration(spark: SparkSession, folder: str) -> DataFrame:
    lenient = timeexpr.duration_us(F.col("expr"), strict=False, allow_negative=True)
    return expressions(spark, folder).select(*IDS, lenient.alias("us"))


@query("t02_duration_strict", f"WITH {EXPR} SELECT {ID_LIST}, {us_sql('expr')} AS us FROM e")
def duration_strict(spark: SparkSession, folder: str) -> DataFrame:
    return expressions(spark, folder).select(*IDS, timeexpr.duration_us(F.col("expr")).alias("us"))


@query("t03_interval", f"WITH {EXPR}, {parsed_sql('e', 'expr')} SELECT {ID_LIST}, start_us, end_us, is_interval FROM p")
def interval(spark: SparkSession, folder: str) -> DataFrame:
    parsed = texts.once(expressions(spark, folder), "expr", "t", timeexpr.interval)
    return parsed.select(*IDS, "t.start_us", "t.end_us", "t.is_interval")


@query(
    "t04_interval_kind",
    f"""WITH {EXPR}, {parsed_sql('e', 'expr')} SELECT {ID_LIST}, is_interval, NOT is_interval AS is_point,
    CASE WHEN is_interval THEN start_us - end_us WHEN NOT is_interval THEN 0 END AS range_us FROM p""",
)
def interval_kind(spark: SparkSession, folder: str) -> DataFrame:
    parsed = expressions(spark, folder).withColumn("t", timeexpr.interval(F.col("expr")))
    t = F.col("t")
    return parsed.select(
        *IDS, timeexpr.is_interval(t).alias("is_interval"), timeexpr.is_point(t).alias("is_point"), timeexpr.range_us(t).alias("range_us")
    )


@query(
    "t05_canonical_text",
    f"""WITH {EXPR}, {parsed_sql('e', 'expr')} SELECT {ID_LIST},
    CASE WHEN is_interval THEN {text_sql('start_us')} || ':' || {text_sql('end_us')} ELSE {text_sql('start_us')} END AS text FROM p""",
)
def canonical_text(spark: SparkSession, folder: str) -> DataFrame:
    return expressions(spark, folder).select(*IDS, timeexpr.interval_text(timeexpr.interval(F.col("expr"))).alias("text"))


@query(
    "t06_duration_arithmetic",
    f"""WITH {EXPR}, {parsed_sql('e', 'expr')} SELECT {ID_LIST}, start_us + end_us AS total, {text_sql('(end_us - start_us)')} AS difference,
    abs(end_us - start_us) AS size, start_us > end_us AS longer FROM p""",
)
def arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    parsed = expressions(spark, folder).withColumn("t", timeexpr.interval(F.col("expr"))).select(*IDS, "t.*")
    start, end = F.col("start_us"), F.col("end_us")
    return parsed.select(
        *IDS,
        (start + end).alias("total"),
        timeexpr.duration_text(end - start).alias("difference"),
        F.abs(end - start).alias("size"),
        (start > end).alias("longer"),
    )


@query(
    "t07_window_samples",
    f"""WITH {EXPR}, {parsed_sql('e', 'expr')} SELECT {ID_LIST},
    CASE WHEN is_interval AND (start_us - end_us) // 60000000 > 0 THEN (start_us - end_us) // 60000000 END AS samples FROM p""",
)
def window_samples(spark: SparkSession, folder: str) -> DataFrame:
    length = timeexpr.range_us(timeexpr.interval(F.col("expr")))
    return expressions(spark, folder).select(*IDS, timeexpr.window_samples(length, timeexpr.UNIT_US["m"]).alias("samples"))


# Rule texts, one per part: every outcome of verification, on sensors the part picks.
RULE_TEXTS = """
SELECT p_partkey AS rule_id, 'rule_' || p_partkey AS rule_name, p_name AS rule_description, lower(p_type) AS rule_type, p_size % 3 AS collection_id,
  CASE p_partkey % 11
    WHEN 9 THEN 'def rule_' || p_partkey || '(status)'
    ELSE 'def rule_' || p_partkey || '(status) -> str:' END || chr(10) || CASE p_partkey % 11
    WHEN 0 THEN '    a = status.get("' || sensor || '", "0")'
    WHEN 1 THEN '    a = status.get("' || sensor || '", "' || p_size || 'm:", "mean")'
    WHEN 2 THEN '    a = status.get("click", "0") - status.get("' || sensor || '", "1h:5m", "max")'
    WHEN 3 THEN '    a = status.get("ghost", "' || p_size || 'm")'
    WHEN 4 THEN '    a = status.get("' || sensor || '", "abc")'
    WHEN 5 THEN '    a = status.get("' || sensor || '", "10m:")'
    WHEN 6 THEN '    a = status.get("' || sensor || '", "10m:", "median")'
    WHEN 7 THEN '    a = status.get("' || sensor || '", "5m", "mean")'
    WHEN 8 THEN '    a = ' || p_size
    WHEN 9 THEN '    a = status.get("' || sensor || '", "0")'
    ELSE '    a = status.get("' || sensor || '", "-5m") + status.get("ghost", name)' END || chr(10)
  || '    if a and a > ' || p_size || ':' || chr(10) || '        return "hit"' || chr(10) || '    return None' AS rule_body
FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS sensor FROM {part})
"""
RULES = f"r AS ({plain(RULE_TEXTS)})"
# The calls of each rule for the statement: constants in place, anything else null.
CALLS = r"""
c0 AS (SELECT rule_id, rule_name, rule_body, unnest(regexp_extract_all(rule_body, 'status\.get\(([^)]+)\)', 1)) AS arguments,
         generate_subscripts(regexp_extract_all(rule_body, 'status\.get\(([^)]+)\)', 1), 1) - 1 AS call_idx FROM r),
c AS (SELECT rule_id, rule_name, call_idx,
        nullif(regexp_extract(split_part(arguments, ',', 1), '^\s*"([^"]*)"\s*$', 1), '') AS sensor_id,
        nullif(regexp_extract(split_part(arguments, ',', 2), '^\s*"([^"]*)"\s*$', 1), '') AS time_expression,
        nullif(regexp_extract(split_part(arguments, ',', 3), '^\s*"([^"]*)"\s*$', 1), '') AS statistic FROM c0)
"""


def rule_texts(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, RULE_TEXTS, "part")


@query("t08_rule_calls", f"WITH {RULES}, {CALLS} SELECT rule_id, call_idx, sensor_id, time_expression, statistic FROM c")
def rule_calls(spark: SparkSession, folder: str) -> DataFrame:
    return rulecalls.calls(rule_texts(spark, folder))


@query(
    "t08_rule_calls_by_syntax",
    f"WITH {RULES}, {CALLS} SELECT rule_id, call_idx, sensor_id, time_expression, statistic FROM c WHERE rule_id % 11 <> 9",
)
def rule_calls_by_syntax(spark: SparkSession, folder: str) -> DataFrame:
    rules = layout.spread(rule_texts(spark, folder).select("rule_id", "rule_body"))
    read = rules.select("rule_id", rulecalls.analyse("rule_body").alias("read"))
    return read.select("rule_id", F.posexplode("read.calls").alias("call_idx", "call")).select("rule_id", "call_idx", "call.*")


@query(
    "t09_requirements",
    f"WITH {RULES}, {CALLS} SELECT DISTINCT sensor_id, time_expression, statistic FROM c WHERE rule_id % 11 <> 9 AND sensor_id IS NOT NULL AND time_expression IS NOT NULL",
)
def requirements(spark: SparkSession, folder: str) -> DataFrame:
    return rulecalls.requirements(rule_texts(spark, folder))


@query(
    "t10_sensors_per_rule",
    f"""WITH {RULES}, {CALLS} SELECT r.rule_id, coalesce(s.sensors, '') AS sensors FROM r LEFT JOIN
    (SELECT rule_id, string_agg(DISTINCT sensor_id, ',' ORDER BY sensor_id) AS sensors FROM c WHERE rule_id % 11 <> 9 GROUP BY rule_id) s ON r.rule_id = s.rule_id""",
)
def sensors_per_rule(spark: SparkSession, folder: str) -> DataFrame:
    read = texts.once(rule_texts(spark, folder), "rule_body", "sensors", rulecalls.sensor_set)
    return read.select("rule_id", F.array_join("sensors", ",").alias("sensors"))
