"""The catalogue (S4, S5, S7, S11, C1-C22) over tables that grow with the given ones.

Customers are collections, orders their documents, order lines chunks, tasks and rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators import catalog as ct
from gaugeflow.plans.registry import derived, plain, query, table
from gaugeflow.sources import rules as sr
from gaugeflow.sources import sensors as ss

LINE_ID = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"
COLLECTIONS = "SELECT c_custkey AS id, c_name AS name, lower(c_mktsegment) AS description FROM {customer}"
DOCUMENTS = """SELECT o_orderkey AS id, o_custkey AS collection_id, 'doc ' || o_orderkey || '.md' AS filename, o_orderdate AS uploaded_at FROM {orders}"""
CHUNKS = f"""SELECT {LINE_ID} AS id, l_orderkey AS document_id, l_linenumber AS chunk_index,
  'line of ' || l_returnflag || l_partkey AS content_preview, l_shipdate AS created_at FROM {{lineitem}}"""
JOBS = "SELECT s_suppkey AS id, s_nationkey AS collection_id, 'pending' AS status FROM {supplier}"
TASKS = f"""SELECT {LINE_ID} AS id, l_suppkey AS job_id, {LINE_ID} AS chunk_id, CASE
  WHEN l_suppkey % 4 = 0 AND l_returnflag = 'R' THEN 'failed' WHEN l_suppkey % 4 = 0 THEN 'completed'
  WHEN l_suppkey % 4 = 1 THEN 'failed' WHEN l_suppkey % 4 = 2 THEN 'pending'
  WHEN l_linestatus = 'O' THEN 'running' WHEN l_returnflag = 'A' THEN 'failed' ELSE 'completed' END AS status FROM {{lineitem}}"""
RULES = f"""SELECT {LINE_ID} AS id, {LINE_ID} AS task_id, l_suppkey AS collection_id, l_orderkey AS document_id, {LINE_ID} AS chunk_id,
  'rule_' || l_partkey || '_' || l_linenumber AS rule_name, 'd' || l_tax AS rule_description, 'reason' AS rule_reasoning, 'section ' || l_linenumber AS rule_source,
  'def f(status): return status.get("s' || l_partkey || '", "0")' AS rule_body,
  CASE l_linenumber WHEN 1 THEN 'safety' WHEN 2 THEN 'operational' WHEN 3 THEN 'maintenance' WHEN 4 THEN 'optimization' END AS rule_type,
  CASE WHEN l_quantity > 45 THEN 'sensors_not_found' WHEN l_quantity < 3 THEN 'no_sensors' ELSE 'ok' END AS sensor_parsing_status,
  CASE WHEN l_quantity > 40 THEN 'parse_error' ELSE 'ok' END AS time_parsing_status,
  CASE WHEN l_quantity > 44 THEN 'invalid_sensor' WHEN l_quantity < 5 THEN 'syntax_error' ELSE 'ok' END AS verification_status,
  CASE l_returnflag WHEN 'R' THEN 'superseded' WHEN 'A' THEN 'consolidated' ELSE 'extracted' END AS lifecycle_status,
  l_shipdate AS created_at FROM {{lineitem}}"""
VIEWS = {
    "collections": (COLLECTIONS, "customer"),
    "docs": (DOCUMENTS, "orders"),
    "chunks": (CHUNKS, "lineitem"),
    "jobs": (JOBS, "supplier"),
    "tasks": (TASKS, "lineitem"),
    "rules": (RULES, "lineitem"),
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    statement, source = VIEWS[name]
    return derived(spark, folder, statement, source)


def views(*names: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({plain(VIEWS[name][0])})" for name in names) + " "


# Sensors of part rows: several rows of one key, padded and blank texts.
SENSOR_ROWS = """
SELECT p_size AS collection_id, p_partkey AS position, CASE WHEN p_partkey % 19 = 0 THEN '  ' ELSE ' ' || p_brand || ' ' END AS id,
  CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_name || ' ' END AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE lower(p_type) END AS description,
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'kg' END AS unit, CAST(p_retailprice AS STRING) AS example FROM {part}
"""
SENSORS = f"""raw AS ({plain(SENSOR_ROWS).replace("AS STRING", "AS VARCHAR")}),
clean AS (SELECT collection_id, position, nullif(trim(id), '') AS sensor_id, nullif(trim(name), '') AS name, nullif(trim(description), '') AS description,
  nullif(trim(unit), '') AS unit, nullif(trim(example), '') AS example FROM raw),
source AS (SELECT * FROM clean WHERE sensor_id IS NOT NULL AND name IS NOT NULL)"""


def sensor_source(spark: SparkSession, folder: str) -> DataFrame:
    return ss.normalize(derived(spark, folder, SENSOR_ROWS, "part"))


@query("s04_sensor_rows", f"WITH {SENSORS} SELECT * FROM source")
def sensor_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sensor_source(spark, folder)


TARGET = """SELECT s_nationkey AS collection_id, 'Brand#' || s_suppkey % 30 AS sensor_id, max(s_name) AS name, CAST(NULL AS STRING) AS description,
  'bar' AS unit, CAST(NULL AS STRING) AS example FROM {supplier} GROUP BY s_nationkey, s_suppkey % 30"""


@query(
    "s05_sensor_upsert",
    f"""WITH {SENSORS}, target AS ({plain(TARGET).replace("AS STRING", "AS VARCHAR")}),
    latest AS (SELECT * FROM source QUALIFY row_number() OVER (PARTITION BY collection_id, sensor_id ORDER BY position DESC) = 1)
    SELECT coalesce(s.collection_id, t.collection_id) AS collection_id, coalesce(s.sensor_id, t.sensor_id) AS sensor_id,
      CASE WHEN s.sensor_id IS NULL THEN t.name ELSE s.name END AS name, CASE WHEN s.sensor_id IS NULL THEN t.description ELSE s.description END AS description,
      CASE WHEN s.sensor_id IS NULL THEN t.unit ELSE s.unit END AS unit, CASE WHEN s.sensor_id IS NULL THEN t.example ELSE s.example END AS example
    FROM target t FULL JOIN latest s ON s.collection_id = t.collection_id AND s.sensor_id = t.sensor_id""",
)
def sensor_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return ss.upsert(derived(spark, folder, TARGET, "supplier"), sensor_source(spark, folder))


@query("c12_sensor_counts", f"WITH {SENSORS} SELECT collection_id, count(*) AS sensors FROM source GROUP BY collection_id")
def sensor_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ct.sensor_counts(sensor_source(spark, folder))


@query("c12_sensors_of_collection", f"WITH {SENSORS} SELECT sensor_id, name, position FROM source WHERE collection_id = 7")
def sensors_of(spark: SparkSession, folder: str) -> DataFrame:
    return ct.sensors_of(sensor_source(spark, folder), 7).select("sensor_id", "name", "position")


@query(
    "s07_load_rules",
    views("rules")
    + f"SELECT collection_id, id, {', '.join(sr.LOADED)} FROM rules WHERE lifecycle_status <> 'superseded' AND verification_status = 'ok'",
)
def load_rules(spark: SparkSession, folder: str) -> DataFrame:
    return sr.load_all(view(spark, folder, "rules"))


@query(
    "s07_load_newest",
    views("rules")
    + f"""SELECT collection_id, id, {', '.join(sr.LOADED)} FROM
    (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY created_at DESC, id) AS place FROM rules)
    WHERE place <= 1000 AND lifecycle_status <> 'superseded' AND verification_status = 'ok'""",
)
def load_newest(spark: SparkSession, folder: str) -> DataFrame:
    return sr.load_all(view(spark, folder, "rules"), limit=1000)


@query(
    "s07_load_collection",
    views("rules")
    + f"SELECT {', '.join(sr.LOADED)} FROM rules WHERE collection_id = 3 AND verification_status = 'ok'",
)
def load_collection(spark: SparkSession, folder: str) -> DataFrame:
    return sr.load_rules(view(spark, folder, "rules"), collection_id=3, parity=True)


@query("s11_consolidation_columns", views("rules") + f"SELECT id, {', '.join(sr.LOADED)} FROM rules")
def consolidation_columns(spark: SparkSession, folder: str) -> DataFrame:
    return sr.for_consolidation(view(spark, folder, "rules"))


@query(
    "c01_rules_page",
    views("rules") + "SELECT id, rule_name, created_at FROM rules WHERE collection_id = 5 ORDER BY created_at DESC, id LIMIT 100 OFFSET 50",
)
def rules_page(spark: SparkSession, folder: str) -> DataFrame:
    return ct.rules_page(view(spark, folder, "rules"), 5, 100, 50).select("id", "rule_name", "created_at")


@query("c02_rules_by_type", views("rules") + "SELECT id, rule_name FROM rules WHERE collection_id = 5 AND rule_type = 'safety'")
def rules_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return ct.rules_by(view(spark, folder, "rules"), collection_id=5, rule_type="safety").select("id", "rule_name")


@query("c02_rules_of_document", views("rules") + "SELECT id, rule_name, document_id FROM rules WHERE document_id = 7")
def rules_of_document(spark: SparkSession, folder: str) -> DataFrame:
    return ct.rules_by(view(spark, folder, "rules"), document_id=7).select("id", "rule_name", "document_id")


@query("c02_rules_of_task", views("rules") + "SELECT id, rule_name, task_id FROM rules WHERE task_id = (SELECT min(task_id) FROM rules)")
def rules_of_task(spark: SparkSession, folder: str) -> DataFrame:
    rules = view(spark, folder, "rules")
    return rules.join(rules.agg(F.min("task_id").alias("task_id")), "task_id", "left_semi").select("id", "rule_name", "task_id")


@query("c03_rule_counts", views("rules") + "SELECT collection_id, count(*) AS total_rules FROM rules GROUP BY collection_id")
def rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ct.rule_counts(view(spark, folder, "rules"))


@query(
    "c03_rule_stats",
    views("rules")
    + """, kinds AS (SELECT collection_id, 'total' AS kind, '' AS key, created_at FROM rules
      UNION ALL SELECT collection_id, 'type', coalesce(rule_type, 'unclassified'), created_at FROM rules
      UNION ALL SELECT collection_id, 'document', CAST(document_id AS VARCHAR), created_at FROM rules)
    SELECT collection_id, kind, key, count(*) AS rules, max(created_at) AS latest FROM kinds GROUP BY ALL""",
)
def rule_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ct.rule_stats(view(spark, folder, "rules"))


@query("c04_active_rules", views("rules") + "SELECT id, collection_id, lifecycle_status FROM rules WHERE lifecycle_status <> 'superseded'")
def active_rules(spark: SparkSession, folder: str) -> DataFrame:
    return ct.active(view(spark, folder, "rules")).select("id", "collection_id", "lifecycle_status")


@query(
    "c05_active_rules_of_jobs",
    views("rules", "tasks")
    + "SELECT rules.id, job_id FROM rules JOIN tasks ON tasks.id = rules.task_id WHERE lifecycle_status <> 'superseded'",
)
def active_of_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return ct.active_of_job(view(spark, folder, "rules"), view(spark, folder, "tasks")).select("id", "job_id")


def chosen(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "tasks").where("status = 'failed'").select("id")


@query(
    "c06_mark_superseded",
    views("rules", "tasks")
    + """SELECT id, CASE WHEN id IN (SELECT id FROM tasks WHERE status = 'failed') THEN 'superseded' ELSE lifecycle_status END AS lifecycle_status FROM rules""",
)
def mark_superseded(spark: SparkSession, folder: str) -> DataFrame:
    return ct.mark_superseded(view(spark, folder, "rules"), chosen(spark, folder)).select("id", "lifecycle_status")


@query("c06_marked_count", views("rules", "tasks") + "SELECT count(*) AS marked FROM rules WHERE id IN (SELECT id FROM tasks WHERE status = 'failed')")
def marked_count(spark: SparkSession, folder: str) -> DataFrame:
    return ct.marked_count(view(spark, folder, "rules"), chosen(spark, folder))


@query("c07_rules_by_ids", views("rules", "tasks") + "SELECT id, rule_name FROM rules WHERE id IN (SELECT id FROM tasks WHERE status = 'failed')")
def rules_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    return ct.by_ids(view(spark, folder, "rules"), chosen(spark, folder)).select("id", "rule_name")


# Retrieved for each task: the chunks of the same document that come before, and one search per line.
CONTEXT = f"""SELECT a.id AS task_id, b.id AS chunk_id, b.chunk_index / 10.0D AS relevance_score, b.chunk_index AS rank
FROM ({CHUNKS}) a JOIN ({CHUNKS}) b ON a.document_id = b.document_id AND b.chunk_index < a.chunk_index"""
CONTEXT_SQL = CONTEXT.replace("{lineitem}", "lineitem").replace("10.0D", "10.0")
SEARCHES = f"SELECT {LINE_ID} AS task_id, 'limit of ' || l_partkey AS search_query, '[]' AS search_results, 1 AS search_rank FROM {{lineitem}}"


def context(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, CONTEXT, "lineitem")


def searches(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, SEARCHES, "lineitem")


@query(
    "c08_rule_detail",
    views("rules", "docs", "chunks")
    + f""", context AS ({CONTEXT_SQL}),
    own AS (SELECT rules.id AS rule_id, context.* FROM rules JOIN context USING (task_id)),
    lists AS (SELECT rule_id, string_agg(rank || ':' || chunk_id || ':' || k.content_preview || ':' || d.filename, ';' ORDER BY rank, chunk_id, k.content_preview) AS context
      FROM own JOIN chunks k ON k.id = chunk_id JOIN docs d ON d.id = k.document_id GROUP BY rule_id)
    SELECT r.id AS rule_id, r.rule_name, d.filename AS document_filename, k.chunk_index, coalesce(lists.context, '') AS context,
      'limit of ' || (r.id // 10000) % 100000 AS search
    FROM rules r LEFT JOIN docs d ON d.id = r.document_id LEFT JOIN chunks k ON k.id = r.chunk_id LEFT JOIN lists ON lists.rule_id = r.id""",
)
def rule_detail(spark: SparkSession, folder: str) -> DataFrame:
    rules, docs, chunks = (view(spark, folder, name) for name in ("rules", "docs", "chunks"))
    rules = rules.select("id", "task_id", "document_id", "chunk_id", "rule_name")
    rule_chunks, rule_searches = ct.provenance(rules, ct.placed(context(spark, folder), chunks, docs), searches(spark, folder), by_task=True)
    made = ct.rule_detail(rules, docs, chunks, rule_chunks, rule_searches)
    entry = lambda c: F.concat_ws(":", c["rank"], c["chunk_id"], c["content_preview"], c["document_filename"])
    return made.select(
        "rule_id",
        "rule_name",
        "document_filename",
        "chunk_index",
        F.coalesce(F.array_join(F.transform("context_chunks", entry), ";"), F.lit("")).alias("context"),
        F.col("grounding_searches")[0]["search_query"].alias("search"),
    )


@query(
    "c17_provenance_chunks",
    views("rules")
    + f", context AS ({CONTEXT_SQL}) SELECT rules.id AS rule_id, context.chunk_id, relevance_score, rank FROM rules JOIN context USING (task_id)",
)
def provenance_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return ct.provenance(view(spark, folder, "rules"), context(spark, folder), searches(spark, folder))[0]


@query(
    "c17_provenance_searches",
    views("rules")
    + f", found AS ({plain(SEARCHES)}) SELECT rules.id AS rule_id, search_query, search_results, search_rank FROM rules JOIN found USING (task_id)",
)
def provenance_searches(spark: SparkSession, folder: str) -> DataFrame:
    return ct.provenance(view(spark, folder, "rules"), context(spark, folder), searches(spark, folder))[1]


@query(
    "c09_collection_counts",
    views("collections", "docs", "chunks")
    + """SELECT c.id AS collection_id, count(DISTINCT d.id) AS documents, count(k.id) AS chunks
    FROM collections c LEFT JOIN docs d ON d.collection_id = c.id LEFT JOIN chunks k ON k.document_id = d.id GROUP BY c.id""",
)
def collection_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ct.document_counts(*(view(spark, folder, name) for name in ("collections", "docs", "chunks")))


@query(
    "c09_document_counts",
    views("docs", "chunks") + "SELECT d.id AS document_id, count(k.id) AS chunks FROM docs d LEFT JOIN chunks k ON k.document_id = d.id GROUP BY d.id",
)
def document_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ct.chunk_counts(view(spark, folder, "docs"), view(spark, folder, "chunks"))


@query(
    "c10_chunk_listing",
    views("docs", "chunks")
    + """SELECT k.id, document_id, filename AS document_filename, chunk_index, content_preview, length(content_preview) AS preview_length, created_at
    FROM chunks k JOIN docs d ON d.id = k.document_id""",
)
def chunk_listing(spark: SparkSession, folder: str) -> DataFrame:
    return ct.chunk_listing(view(spark, folder, "chunks"), view(spark, folder, "docs")).drop("collection_id")


LISTED = "SELECT k.id, document_id, filename AS document_filename, chunk_index FROM chunks k JOIN docs d ON d.id = k.document_id"


@query("c10_chunks_of_document", views("docs", "chunks") + LISTED + " WHERE document_id = 7")
def chunks_of_document(spark: SparkSession, folder: str) -> DataFrame:
    listing = ct.chunk_listing(view(spark, folder, "chunks").where("document_id = 7"), view(spark, folder, "docs"))
    return listing.select("id", "document_id", "document_filename", "chunk_index")


@query("c10_chunks_of_collection", views("docs", "chunks") + LISTED + " WHERE collection_id % 50 = 1")
def chunks_of_collections(spark: SparkSession, folder: str) -> DataFrame:
    listing = ct.chunk_listing(view(spark, folder, "chunks"), view(spark, folder, "docs").where("collection_id % 50 = 1"))
    return listing.select("id", "document_id", "document_filename", "chunk_index")


@query("c10_chunks_by_ids", views("docs", "chunks", "rules") + LISTED + " WHERE k.id IN (SELECT chunk_id FROM rules WHERE rule_type = 'safety')")
def chunks_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    wanted = view(spark, folder, "rules").where("rule_type = 'safety'").select(F.col("chunk_id").alias("id"))
    listing = ct.chunk_listing(view(spark, folder, "chunks").join(wanted, "id", "left_semi"), view(spark, folder, "docs"))
    return listing.select("id", "document_id", "document_filename", "chunk_index")


@query("c11_collections", views("collections") + "SELECT id, name, description FROM collections")
def collections(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "collections").orderBy("name", "id")


@query("c11_jobs_of_collection", views("jobs") + "SELECT id, status FROM jobs WHERE collection_id = 3")
def jobs_of_collection(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "jobs").where("collection_id = 3").orderBy("id").select("id", "status")


@query("c12_sensor_by_key", f"WITH {SENSORS} SELECT collection_id, sensor_id, name FROM source WHERE collection_id = 7 AND sensor_id = 'Brand#13'")
def sensor_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return ct.sensor(sensor_source(spark, folder), 7, "Brand#13").select("collection_id", "sensor_id", "name")


@query("c11_documents_newest", views("docs") + "SELECT id, collection_id, filename, uploaded_at FROM docs")
def documents_newest(spark: SparkSession, folder: str) -> DataFrame:
    return ct.newest(view(spark, folder, "docs"), "uploaded_at")


@query("c11_tasks_of_job", views("tasks") + "SELECT id, chunk_id, status FROM tasks WHERE job_id = 9")
def tasks_of_job(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "tasks").where("job_id = 9").orderBy("id").select("id", "chunk_id", "status")


CASCADE = """, gone AS (SELECT id FROM collections WHERE description IN ('machinery', 'building')),
d AS (SELECT * FROM docs WHERE collection_id IN (SELECT id FROM collections) AND collection_id NOT IN (SELECT id FROM gone)),
k AS (SELECT * FROM chunks WHERE document_id IN (SELECT id FROM d)),
t AS (SELECT * FROM tasks WHERE chunk_id IN (SELECT id FROM k)),
r AS (SELECT * FROM rules WHERE document_id IN (SELECT id FROM d) AND chunk_id IN (SELECT id FROM k) AND task_id IN (SELECT id FROM t))
"""


@query(
    "c13_cascade_delete",
    views("collections", "docs", "chunks", "tasks", "rules")
    + CASCADE
    + """SELECT 'collections' AS name, id FROM collections WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'documents', id FROM d
    UNION ALL SELECT 'chunks', id FROM k UNION ALL SELECT 'processing_tasks', id FROM t UNION ALL SELECT 'rules', id FROM r""",
)
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    collections = view(spark, folder, "collections")
    left = ct.delete_collections(
        collections.where(F.col("description").isin("machinery", "building")),
        {
            "collections": collections,
            "documents": view(spark, folder, "docs"),
            "chunks": view(spark, folder, "chunks"),
            "processing_tasks": view(spark, folder, "tasks").drop("job_id"),
            "rules": view(spark, folder, "rules").drop("collection_id"),
        },
    )
    parts = [rows.select(F.lit(name).alias("name"), F.col("id").cast("bigint").alias("id")) for name, rows in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "c14_job_progress",
    views("jobs", "tasks")
    + """, n AS (SELECT job_id, count(*) AS total, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'failed') AS bad,
      count(*) FILTER (status = 'running') AS busy FROM tasks GROUP BY job_id)
    SELECT id, coalesce(total, 0) AS total_chunks, coalesce(done, 0) AS completed_chunks, coalesce(bad, 0) AS failed_chunks,
      CASE WHEN total > 0 AND done + bad = total THEN CASE WHEN done = 0 THEN 'failed' ELSE 'completed' END WHEN busy > 0 THEN 'running' ELSE status END AS status,
      round(coalesce((done + bad) * 100.0 / total, 0), 6) AS progress_percentage
    FROM jobs LEFT JOIN n ON n.job_id = jobs.id""",
)
def job_progress(spark: SparkSession, folder: str) -> DataFrame:
    made = ct.job_progress(view(spark, folder, "jobs"), view(spark, folder, "tasks"))
    return made.select(
        "id", "total_chunks", "completed_chunks", "failed_chunks", "status", F.round("progress_percentage", 6).alias("progress_percentage")
    )


@query("c15_create_tasks", views("chunks") + "SELECT 42 AS job_id, id AS chunk_id, 'pending' AS status FROM chunks")
def create_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return ct.create_tasks(view(spark, folder, "chunks"), 42).drop("created_at")


@query(
    "c16_new_collections",
    """WITH wanted AS (SELECT p_name AS name, p_brand AS description, p_partkey AS position FROM part
      UNION ALL SELECT c_name, c_mktsegment, c_custkey FROM customer)
    SELECT name, description, 'collection_' || replace(lower(name), ' ', '_') AS slug FROM wanted
    WHERE name NOT IN (SELECT c_name FROM customer) QUALIFY row_number() OVER (PARTITION BY name ORDER BY position) = 1""",
)
def new_collections(spark: SparkSession, folder: str) -> DataFrame:
    wanted = derived(
        spark,
        folder,
        "SELECT p_name AS name, p_brand AS description, p_partkey AS position FROM {part} UNION ALL SELECT c_name, c_mktsegment, c_custkey FROM {customer}",
        "part",
        "customer",
    )
    return ct.new_collections(view(spark, folder, "collections"), wanted)


@query(
    "c18_issue_counts",
    views("rules")
    + """SELECT collection_id, count(*) AS total_rules, count(*) FILTER (lifecycle_status <> 'superseded') AS active_rules,
    count(*) FILTER (lifecycle_status <> 'superseded' AND verification_status = 'ok') AS verified,
    count(*) FILTER (lifecycle_status <> 'superseded' AND sensor_parsing_status = 'sensors_not_found') AS sensor_issues,
    count(*) FILTER (lifecycle_status <> 'superseded' AND verification_status = 'syntax_error') AS syntax_errors FROM rules GROUP BY collection_id""",
)
def issue_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ct.issues(view(spark, folder, "rules"))


# Changes of a job, one per order line of a supplier; the time is the shipping date and the line id breaks ties.
CHANGES = f"""SELECT l_suppkey AS job_id, CASE l_linenumber % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
  o_orderdate AS changed, {LINE_ID} AS line, CASE WHEN l_linenumber % 4 = 3 THEN 'error ' || l_partkey END AS error
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey"""


@query(
    "c20_latest_status",
    f"""WITH changes AS ({plain(CHANGES)}) SELECT job_id, max(changed) AS last_change, min(changed) FILTER (status = 'running') AS started_at,
    max(changed) FILTER (status IN ('completed', 'failed')) AS completed_at, last(status ORDER BY changed, line) AS status, last(error ORDER BY changed, line) FILTER (error IS NOT NULL) AS error
    FROM changes GROUP BY job_id""",
)
def latest_status(spark: SparkSession, folder: str) -> DataFrame:
    changes = derived(spark, folder, CHANGES, "lineitem", "orders")
    return ct.latest_status(changes, "job_id", "changed", "line")


@query(
    "c19_durations",
    f"""WITH changes AS ({plain(CHANGES)}), jobs AS (SELECT job_id, min(changed) FILTER (status = 'running') AS started_at,
    max(changed) FILTER (status IN ('completed', 'failed')) AS completed_at FROM changes GROUP BY job_id)
    SELECT job_id, (epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0 AS duration_seconds FROM jobs""",
)
def durations(spark: SparkSession, folder: str) -> DataFrame:
    changes = derived(spark, folder, CHANGES, "lineitem", "orders")
    return ct.durations(ct.latest_status(changes, "job_id", "changed")).select("job_id", "duration_seconds")


INCOMING = f"""SELECT {LINE_ID} AS task_id, l_suppkey AS collection_id, l_orderkey AS document_id, {LINE_ID} AS chunk_id, 'rule_' || l_partkey AS rule_name,
  'd' AS rule_description, 'r' AS rule_reasoning, CASE WHEN l_quantity < 49 THEN 's' END AS rule_source, 'b' AS rule_body_original, 'b' AS rule_body,
  CASE l_linenumber WHEN 1 THEN 'OK' WHEN 2 THEN 'No_Sensors' WHEN 3 THEN 'broken' END AS sensor_parsing_status,
  CASE WHEN l_returnflag = 'R' THEN 'SYNTAX_ERROR' END AS verification_status FROM {{lineitem}}"""


@query(
    "c21_rule_append",
    f"""WITH incoming AS ({plain(INCOMING)}) SELECT task_id, rule_name, lower(coalesce(sensor_parsing_status, 'ok')) AS sensor_parsing_status,
    'ok' AS time_parsing_status, lower(coalesce(verification_status, 'ok')) AS verification_status, 'extracted' AS lifecycle_status, false AS is_consolidated
    FROM incoming WHERE rule_source IS NOT NULL AND lower(coalesce(sensor_parsing_status, 'ok')) IN ('no_sensors', 'sensors_not_found', 'ok')""",
)
def rule_append(spark: SparkSession, folder: str) -> DataFrame:
    ready, _ = ct.prepare_rules(derived(spark, folder, INCOMING, "lineitem"))
    return ready.select(
        "task_id", "rule_name", "sensor_parsing_status", "time_parsing_status", "verification_status", "lifecycle_status", "is_consolidated"
    )


@query(
    "c21_rule_rejects",
    f"""WITH incoming AS ({plain(INCOMING)}) SELECT task_id, concat_ws(',', CASE WHEN rule_source IS NULL THEN 'rule_source' END,
      CASE WHEN sensor_parsing_status = 'broken' THEN 'sensor_parsing_status' END) AS errors
    FROM incoming WHERE rule_source IS NULL OR sensor_parsing_status = 'broken'""",
)
def rule_rejects(spark: SparkSession, folder: str) -> DataFrame:
    _, rejected = ct.prepare_rules(derived(spark, folder, INCOMING, "lineitem"))
    return rejected.select("task_id", F.array_join("errors", ",").alias("errors"))


@query(
    "c22_finalize_job",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey = 4 THEN 'completed' ELSE 'running' END AS status,
    CASE WHEN s_suppkey = 4 THEN (SELECT count(*) FROM lineitem) END AS input_rules_count,
    CASE WHEN s_suppkey = 4 THEN (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') END AS output_rules_count,
    CASE WHEN s_suppkey = 4 THEN (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') END AS rules_removed FROM supplier""",
)
def finalize_job(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast("bigint")
    jobs = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit("running").alias("status"), none.alias("input_rules_count"), none.alias("output_rules_count"),
        none.alias("rules_removed"), none.alias("rules_merged"), none.alias("rules_simplified"),
        F.lit(None).cast("string").alias("consolidation_summary"), F.lit(None).cast("timestamp").alias("completed_at"),
    )
    flag = F.col("l_returnflag")
    summary = table(spark, folder, "lineitem").agg(
        F.count(F.lit(1)).alias("input_count"), F.count_if(flag == "A").alias("output_count"), F.count_if(flag == "R").alias("remove_count"),
        F.count_if(flag == "N").alias("merge_count"), F.lit(0).cast("bigint").alias("simplify_count"),
    )
    return ct.finalize_job(jobs, 4, summary).select("id", "status", "input_rules_count", "output_rules_count", "rules_removed")
