"""Rule tables: parsing, resolution, verification, batching, consolidation (V1-V15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators import consolidation as co
from gaugeflow.operators import layout
from gaugeflow.operators import rulebase as rb
from gaugeflow.plans.grammar_queries import CALLS, RULES, parsed_sql, rule_texts
from gaugeflow.plans.registry import derived, plain, query, table

# Model answers, one per order: plain, fenced, broken, empty, badly named, without a call.
ANSWERS = """
SELECT o_orderkey AS task_id, CASE o_orderkey % 6
  WHEN 1 THEN 'Here are the rules.' || chr(10) || '```json' || chr(10) || rules || chr(10) || '```'
  WHEN 2 THEN '{{"rules": [{{"rule_name": "cut_' || o_orderkey
  WHEN 3 THEN '{{"rules": []}}'
  ELSE rules END AS answer
FROM (SELECT *, '{{"rules": [{{"rule_name": "' || CASE o_orderkey % 6 WHEN 4 THEN 'HighTemp' ELSE 'rule_' || o_orderkey END
  || '", "rule_description": "' || lower(o_orderpriority) || '", "rule_reasoning": "limit of ' || o_custkey
  || '", "rule_source": "Section ' || o_orderkey % 9 || '", "rule_body": "' || CASE o_orderkey % 6
    WHEN 5 THEN 'return None' ELSE 'def rule(status): return status.get(s, t)' END
  || '", "rule_type": "safety"}}, {{"rule_name": "second_' || o_orderkey || '", "rule_description": "d", "rule_reasoning": "r", "rule_source": "s", "rule_body": "def f(status): status.get(a)"}}]}}' AS rules
  FROM {orders})
"""
PARSED = f"""a AS ({plain(ANSWERS)}),
body AS (SELECT task_id, CASE WHEN contains(answer, '```') THEN regexp_extract(answer, '(?s)```(?:json)?\\s*\\n(.*?)\\n```', 1) ELSE answer END AS body FROM a),
items AS (SELECT task_id, body, unnest(CASE WHEN json_valid(body) THEN json_extract(body, '$.rules[*]') END) AS rule,
    generate_subscripts(CASE WHEN json_valid(body) THEN json_extract(body, '$.rules[*]') END, 1) - 1 AS rule_idx FROM body),
rows AS (SELECT task_id, rule_idx, rule ->> 'rule_name' AS rule_name, rule ->> 'rule_description' AS rule_description,
    rule ->> 'rule_reasoning' AS rule_reasoning, rule ->> 'rule_source' AS rule_source, rule ->> 'rule_body' AS rule_body,
    rule ->> 'rule_type' AS rule_type, CAST(NULL AS VARCHAR) AS error FROM items
  UNION ALL SELECT task_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'json' FROM body WHERE NOT json_valid(body))
"""


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Parsing is dear per answer: the rows are spread before their texts are made."""
    return spark.sql(ANSWERS, orders=layout.spread(table(spark, folder, "orders")))


@query("v01_parse_answers", f"WITH {PARSED} SELECT * FROM rows")
def parse_answers(spark: SparkSession, folder: str) -> DataFrame:
    return rb.parse_answers(answers(spark, folder))


@query(
    "v02_schema_checks",
    f"""WITH {PARSED} SELECT task_id, rule_idx, concat_ws('; ',
      CASE WHEN NOT regexp_matches(replace(rule_name, '_', ''), '^[A-Za-z0-9]+$') THEN 'rule_name must be alphanumeric snake_case' END,
      CASE WHEN rule_name <> lower(rule_name) THEN 'rule_name must be lowercase' END,
      CASE WHEN NOT contains(rule_body, 'def ') THEN 'rule_body must define a function' END,
      CASE WHEN NOT contains(rule_body, 'status.get(') THEN 'rule_body must call status.get()' END) AS errors
    FROM rows WHERE error IS NULL""",
)
def schema_checks(spark: SparkSession, folder: str) -> DataFrame:
    parsed = rb.parse_answers(answers(spark, folder)).where("error is null")
    return rb.checked(parsed).select("task_id", "rule_idx", F.array_join("errors", "; ").alias("errors"))


@query(
    "v02_rejected_answers",
    f"""WITH {PARSED}, bad AS (SELECT task_id, rule_idx, error IS NOT NULL OR rule_name <> lower(rule_name) OR NOT contains(rule_body, 'def ') OR NOT contains(rule_body, 'status.get(') AS wrong,
      error FROM rows)
    SELECT task_id, rule_idx, CASE WHEN error IS NOT NULL THEN 'answer: ' || error WHEN wrong THEN 'own' ELSE 'another rule of the answer is rejected' END AS why
    FROM bad WHERE task_id IN (SELECT task_id FROM bad WHERE wrong)""",
)
def rejected_answers(spark: SparkSession, folder: str) -> DataFrame:
    _, rejected = rb.check_schema(rb.parse_answers(answers(spark, folder)), per=("task_id",))
    text = F.array_join("errors", "; ")
    return rejected.select("task_id", "rule_idx", F.when(text.startswith("rule_"), F.lit("own")).otherwise(text).alias("why"))


# Rules written with names of things and times, one per part, and what those names mean.
DESCRIBED = """
SELECT p_partkey AS rule_id, p_size % 4 AS collection_id, CASE p_partkey % 5
  WHEN 0 THEN 'x = status.get("' || p_name || '", "current")'
  WHEN 1 THEN 'x = status.get("' || p_name || '", "last ' || p_size || ' minutes") + status.get("' || p_name || ' top", "current")'
  WHEN 2 THEN 'x = status.get("' || p_name || ' top", "an hour ago") - status.get("' || p_name || '", "mean of the hour")'
  WHEN 3 THEN 'x = status.get("unknown ' || p_size || '", "sometime")'
  ELSE 'x = ' || p_size END AS rule_body
FROM {part}
"""
SENSOR_NAMES = """
SELECT p_partkey AS rule_id, p_name AS sensor_description, 'S' || p_size AS sensor_id FROM {part}
UNION ALL SELECT p_partkey, p_name || ' top', CASE WHEN p_size % 7 <> 0 THEN 'T' || p_size END FROM {part}
"""
TIME_NAMES = """
SELECT 'current' AS time_description, '0' AS time_expression, NULL AS time_statistic
UNION ALL SELECT 'an hour ago', '1h', NULL
UNION ALL SELECT 'mean of the hour', '1h:', 'mean'
UNION ALL SELECT DISTINCT 'last ' || p_size || ' minutes', p_size || 'm:', CASE WHEN p_size % 2 = 0 THEN 'max' END FROM {part}
"""


@query(
    "v03_resolve_sensors",
    f"""WITH d AS ({plain(DESCRIBED)}), m AS ({plain(SENSOR_NAMES)}),
    step AS (SELECT d.*, a.sensor_description AS d1, a.sensor_id AS s1, b.sensor_description AS d2, b.sensor_id AS s2
      FROM d LEFT JOIN m a ON a.rule_id = d.rule_id AND NOT ends_with(a.sensor_description, ' top')
             LEFT JOIN m b ON b.rule_id = d.rule_id AND ends_with(b.sensor_description, ' top'))
    SELECT rule_id, rule_body AS rule_body_original,
      replace(CASE WHEN s2 IS NULL THEN rule_body ELSE replace(rule_body, '"' || d2 || '"', '"' || s2 || '"') END, '"' || d1 || '"', '"' || s1 || '"') AS rule_body,
      CASE WHEN NOT contains(rule_body, 'status.get(') THEN 'no_sensors'
           WHEN contains(rule_body, '"unknown ') OR (contains(rule_body, ' top"') AND s2 IS NULL) THEN 'sensors_not_found'
           ELSE 'ok' END AS sensor_parsing_status
    FROM step""",
)
def resolve_sensors(spark: SparkSession, folder: str) -> DataFrame:
    rules = derived(spark, folder, DESCRIBED, "part").drop("collection_id")
    return rb.resolve_sensors(rules, derived(spark, folder, SENSOR_NAMES, "part"))


@query(
    "v04_sensor_status",
    f"""WITH d AS ({plain(DESCRIBED)}),
    s AS (SELECT DISTINCT s_nationkey % 3 AS collection_id, true AS stocked FROM supplier)
    SELECT status AS sensor_parsing_status, count(*) AS rules FROM (
      SELECT CASE WHEN s.stocked IS NULL THEN 'sensors_not_found'
        WHEN NOT contains(rule_body, 'status.get(') THEN 'no_sensors'
        WHEN contains(rule_body, '"unknown ') OR (contains(rule_body, ' top"') AND p_size % 7 = 0) THEN 'sensors_not_found' ELSE 'ok' END AS status
      FROM d JOIN part ON p_partkey = rule_id LEFT JOIN s USING (collection_id)) GROUP BY status""",
)
def sensor_status(spark: SparkSession, folder: str) -> DataFrame:
    sensors = derived(spark, folder, "SELECT s_nationkey % 3 AS collection_id, s_name AS sensor_id FROM {supplier}", "supplier")
    done = rb.resolve_sensors(
        derived(spark, folder, DESCRIBED, "part"), derived(spark, folder, SENSOR_NAMES, "part"), sensors
    )
    return done.groupBy("sensor_parsing_status").agg(F.count(F.lit(1)).alias("rules"))


@query(
    "v05_resolve_times",
    f"""WITH d AS ({plain(DESCRIBED)}) SELECT rule_id,
      CASE rule_id % 5
        WHEN 0 THEN replace(rule_body, '"current"', '"0"')
        WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN replace(replace(rule_body, '"current"', '"0"'), '"last ' || p_size || ' minutes"', '"' || p_size || 'm:", "max"')
                         ELSE replace(rule_body, '"current"', '"0"') END
        WHEN 2 THEN replace(replace(rule_body, '"an hour ago"', '"1h"'), '"mean of the hour"', '"1h:", "mean"')
        ELSE rule_body END AS rule_body,
      CASE WHEN rule_id % 5 = 3 OR (rule_id % 5 = 1 AND p_size % 2 = 1) THEN 'parse_error' ELSE 'ok' END AS time_parsing_status
    FROM d JOIN part ON p_partkey = rule_id""",
)
def resolve_times(spark: SparkSession, folder: str) -> DataFrame:
    rules = derived(spark, folder, DESCRIBED, "part").drop("collection_id")
    return rb.resolve_times(rules, derived(spark, folder, TIME_NAMES, "part"))


def event_sensors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_type").alias("sensor_id")).distinct()


VERIFIED = f"""{RULES}, {CALLS}, {parsed_sql('c', 'time_expression')},
judged AS (SELECT rule_id, call_idx, CASE
    WHEN sensor_id IS NULL OR sensor_id NOT IN (SELECT event_type FROM events) THEN 'invalid_sensor'
    WHEN is_interval IS NULL THEN 'invalid_time'
    WHEN is_interval AND (statistic IS NULL OR statistic NOT IN ('mean', 'max', 'min', 'std', 'variance')) THEN 'invalid_statistic'
    WHEN NOT is_interval AND statistic IS NOT NULL THEN 'invalid_statistic' END AS fault FROM p),
faults AS (SELECT rule_id, arg_min(fault, call_idx) AS fault FROM judged WHERE fault IS NOT NULL GROUP BY rule_id),
verified AS (SELECT r.*, CASE WHEN NOT contains(rule_body, '-> str:') THEN 'syntax_error' ELSE coalesce(fault, 'ok') END AS verification_status
  FROM r LEFT JOIN faults USING (rule_id))
"""


@query("v06_verify_rules", f"WITH {VERIFIED} SELECT rule_id, verification_status FROM verified")
def verify_rules(spark: SparkSession, folder: str) -> DataFrame:
    checked = rb.verify(rule_texts(spark, folder), event_sensors(spark, folder))
    return checked.select("rule_id", "verification_status")


BATCHED = f"""{RULES}, {CALLS},
keyed AS (SELECT r.rule_id, coalesce(s.sensors, '__no_sensors__') AS batch_key FROM r LEFT JOIN
    (SELECT rule_id, string_agg(DISTINCT sensor_id, ',' ORDER BY sensor_id) AS sensors FROM c WHERE rule_id % 11 <> 9 GROUP BY rule_id) s ON r.rule_id = s.rule_id),
batched AS (SELECT *, (row_number() OVER (PARTITION BY batch_key ORDER BY rule_id) - 1) // 50 AS batch_no FROM keyed)
"""


@query("v08_rule_batches", f"WITH {BATCHED} SELECT rule_id, batch_key, batch_no FROM batched")
def rule_batches(spark: SparkSession, folder: str) -> DataFrame:
    return co.batches(rule_texts(spark, folder)).select("rule_id", "batch_key", "batch_no")


@query(
    "v09_batch_summary",
    f"""WITH {BATCHED} SELECT count(*) AS analyzed_rules, count(DISTINCT (batch_key, batch_no)) AS rule_batches,
    count(*) // count(DISTINCT (batch_key, batch_no)) AS avg_batch_size FROM batched""",
)
def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return co.batch_summary(co.batches(rule_texts(spark, folder)))


# Actions, one per customer, on rules next to each other; ids as text so both engines read them.
ACTIONS = """
SELECT c_custkey AS action_id,
  CASE WHEN c_custkey % 31 = 0 THEN 'rename' WHEN c_custkey % 3 = 0 THEN 'remove' WHEN c_custkey % 3 = 1 THEN 'merge' ELSE 'simplify' END AS action_type,
  CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN (c_custkey + 1) || ',' || c_custkey ELSE CAST(c_custkey AS STRING) END AS ids,
  CASE WHEN c_custkey % 3 <> 0 THEN 'joined_' || c_custkey END AS out_name,
  CASE WHEN c_custkey % 3 <> 0 THEN CASE c_custkey % 5
    WHEN 1 THEN 'def joined(status): return status.get("ghost", "0")'
    WHEN 2 THEN 'def joined(status) return'
    ELSE 'def joined(status): return status.get("click", "10m:", "mean")' END END AS out_body,
  (c_custkey % 13) / 10.0D AS confidence,
  CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) ELSE 'same limit as ' || lower(c_mktsegment) END AS reasoning
FROM {customer}
"""
ACT = f"""act AS (SELECT * EXCLUDE (ids), CASE WHEN ids = '' THEN []::BIGINT[] ELSE list_transform(string_split(ids, ','), lambda x: x::BIGINT) END AS ids
   FROM ({plain(ACTIONS).replace("10.0D", "10.0").replace("AS STRING", "AS VARCHAR")})),
checked AS (SELECT *, concat_ws(',', CASE WHEN action_type NOT IN ('remove', 'merge', 'simplify') THEN 'action_type' END,
    CASE WHEN len(ids) = 0 THEN 'input_rule_ids' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END,
    CASE WHEN length(reasoning) < 10 THEN 'reasoning' END) AS errors FROM act),
valid AS (SELECT * EXCLUDE (errors) FROM checked WHERE errors = ''),
kept AS (SELECT * FROM valid WHERE confidence >= 0.7),
verified AS (SELECT *, NOT (action_id % 5 IN (1, 2)) AS passed FROM kept WHERE out_name IS NOT NULL)
"""


def actions(spark: SparkSession, folder: str) -> DataFrame:
    rows = derived(spark, folder, ACTIONS, "customer")
    output = F.struct(
        F.col("out_name").alias("rule_name"),
        F.lit("joined").alias("rule_description"),
        F.lit("r").alias("rule_reasoning"),
        F.lit("s").alias("rule_source"),
        F.col("out_body").alias("rule_body"),
        F.lit(None).cast("string").alias("rule_type"),
    )
    ids = F.when(F.col("ids") == "", F.array().cast("array<bigint>")).otherwise(F.split("ids", ",").cast("array<bigint>"))
    return rows.select(
        "action_id", "action_type", ids.alias("input_rule_ids"), F.when(F.col("out_name").isNotNull(), output).alias("output_rule"),
        "confidence", "reasoning",
    )


def kept_actions(spark: SparkSession, folder: str) -> DataFrame:
    return co.confident(co.check_actions(actions(spark, folder))[0], 0.7)


def stored_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules with the columns that outputs inherit."""
    return rule_texts(spark, folder).select(
        "rule_id",
        "rule_name",
        (F.col("rule_id") * 10).alias("task_id"),
        F.col("collection_id").cast("bigint").alias("collection_id"),
        (F.col("rule_id") + 7).alias("document_id"),
        (F.col("rule_id") * 3).alias("chunk_id"),
        F.col("rule_description").alias("source_chunk_preview"),
        F.lit("extracted").alias("lifecycle_status"),
    )


@query("v10_confident_actions", f"WITH {ACT} SELECT action_id, action_type, confidence FROM kept")
def confident_actions(spark: SparkSession, folder: str) -> DataFrame:
    return kept_actions(spark, folder).select("action_id", "action_type", "confidence")


@query("v11_action_checks", f"WITH {ACT} SELECT action_id, errors FROM checked")
def action_checks(spark: SparkSession, folder: str) -> DataFrame:
    valid, rejected = co.check_actions(actions(spark, folder))
    return valid.select("action_id", F.lit("").alias("errors")).unionByName(
        rejected.select("action_id", F.array_join("errors", ",").alias("errors"))
    )


@query(
    "v07_verify_outputs",
    f"""WITH {ACT} SELECT action_id, passed, CASE WHEN action_id % 5 = 2 THEN 'Syntax error' WHEN action_id % 5 = 1 THEN 'Validation failed' END AS reason,
    CASE WHEN passed THEN 'consolidated' END AS lifecycle_status, CASE WHEN passed THEN 'ok' END AS verification_status,
    CASE WHEN passed THEN list_aggregate(ids, 'string_agg', ',') END AS lineage FROM verified""",
)
def verify_outputs(spark: SparkSession, folder: str) -> DataFrame:
    done = co.verify_outputs(kept_actions(spark, folder), event_sensors(spark, folder))
    return done.select(
        "action_id", "passed", "reason", "lifecycle_status", "verification_status", F.array_join("consolidated_from_ids", ",").alias("lineage")
    )


GONE = """
gone AS (SELECT DISTINCT unnest(ids) AS rule_id FROM (
   SELECT ids FROM kept WHERE action_type = 'remove' AND out_name IS NULL UNION ALL SELECT ids FROM verified WHERE passed)),
gone_parity AS (SELECT DISTINCT unnest(ids) AS rule_id FROM kept WHERE out_name IS NOT NULL)
"""


@query(
    "v12_consolidation_summary",
    f"""WITH {ACT}, {GONE} SELECT (SELECT count(*) FROM part) AS input_count, (SELECT count(*) FROM verified WHERE passed) AS output_count,
    (SELECT count(*) FROM gone) AS superseded_count, count(*) FILTER (action_type = 'remove') AS remove_count,
    count(*) FILTER (action_type = 'merge') AS merge_count, count(*) FILTER (action_type = 'simplify') AS simplify_count,
    (SELECT count(*) FROM verified WHERE NOT passed) AS failed_count FROM kept""",
)
def consolidation_summary(spark: SparkSession, folder: str) -> DataFrame:
    kept = kept_actions(spark, folder)
    verified = co.verify_outputs(kept, event_sensors(spark, folder))
    return co.summarize(rule_texts(spark, folder), kept, verified, co.superseded_ids(kept, verified))


@query("v12_superseded_ids", f"WITH {ACT}, {GONE} SELECT rule_id FROM gone")
def superseded(spark: SparkSession, folder: str) -> DataFrame:
    kept = kept_actions(spark, folder)
    return co.superseded_ids(kept, co.verify_outputs(kept, event_sensors(spark, folder)))


@query("v12_superseded_ids_parity", f"WITH {ACT}, {GONE} SELECT rule_id FROM gone_parity")
def superseded_parity(spark: SparkSession, folder: str) -> DataFrame:
    kept = kept_actions(spark, folder)
    return co.superseded_ids(kept, co.verify_outputs(kept, event_sensors(spark, folder)), parity=True)


@query(
    "v13_apply_lifecycle",
    f"""WITH {ACT}, {GONE} SELECT p_partkey AS rule_id, CASE WHEN gone.rule_id IS NULL THEN 'extracted' ELSE 'superseded' END AS lifecycle_status
    FROM part LEFT JOIN gone ON gone.rule_id = p_partkey""",
)
def apply_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    kept = kept_actions(spark, folder)
    verified = co.verify_outputs(kept, event_sensors(spark, folder))
    marked, _ = co.apply_actions(stored_rules(spark, folder), verified, co.superseded_ids(kept, verified), 1)
    return marked.select("rule_id", "lifecycle_status")


@query(
    "v13_apply_outputs",
    f"""WITH {ACT}, origin AS (SELECT action_id, min(p_partkey) AS origin FROM (SELECT action_id, unnest(ids) AS id FROM verified WHERE passed)
      JOIN part ON p_partkey = id GROUP BY action_id)
    SELECT action_id, out_name AS rule_name, out_body AS rule_body, origin * 10 AS task_id, origin + 7 AS document_id, origin * 3 AS chunk_id,
      p_name AS source_chunk_preview, confidence AS consolidation_confidence, reasoning AS consolidation_reasoning, 1 AS consolidation_job_id
    FROM verified JOIN origin USING (action_id) JOIN part ON p_partkey = origin""",
)
def apply_outputs(spark: SparkSession, folder: str) -> DataFrame:
    kept = kept_actions(spark, folder)
    verified = co.verify_outputs(kept, event_sensors(spark, folder))
    _, created = co.apply_actions(stored_rules(spark, folder), verified, co.superseded_ids(kept, verified), 1)
    return created.select(
        "action_id", "rule_name", "rule_body", "task_id", "document_id", "chunk_id", "source_chunk_preview", "consolidation_confidence",
        "consolidation_reasoning", "consolidation_job_id",
    )


@query(
    "v14_jobs_to_apply",
    "SELECT s_suppkey AS job_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity = 50 AND l_linenumber = 1 AND l_orderkey % 7 = 0)",
)
def jobs_to_apply(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("job_id"))
    rules = table(spark, folder, "lineitem").select(
        F.expr("l_returnflag = 'A' AND l_quantity = 50 AND l_linenumber = 1 AND l_orderkey % 7 = 0").alias("is_consolidated"),
        F.col("l_suppkey").alias("consolidation_job_id"),
    )
    return co.not_yet_applied(jobs, rules)


@query(
    "v14_jobs_applied",
    "SELECT s_suppkey AS job_id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 30)",
)
def jobs_applied(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("job_id"))
    rules = table(spark, folder, "lineitem").select(
        ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 30)).alias("is_consolidated"),
        F.col("l_suppkey").alias("consolidation_job_id"),
    )
    return co.already_applied(jobs, rules)


@query(
    "v15_reduction",
    """SELECT job_id, round(CASE WHEN input_count > 0 AND output_count > 0 THEN (input_count - output_count) * 100.0 / input_count END, 6) AS reduction_percent,
    round(CASE WHEN input_count > 0 AND output_count > 0 THEN input_count / output_count END, 6) AS consolidation_ratio
    FROM (SELECT l_suppkey AS job_id, count(*) AS input_count, count(*) FILTER (l_returnflag = 'A') AS output_count FROM lineitem GROUP BY l_suppkey)""",
)
def reduction(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("job_id")).agg(
        F.count(F.lit(1)).alias("input_count"), F.count_if(F.col("l_returnflag") == "A").alias("output_count")
    )
    return co.ratios(jobs).select(
        "job_id", F.round("reduction_percent", 6).alias("reduction_percent"), F.round("consolidation_ratio", 6).alias("consolidation_ratio")
    )
