"""Questions about collections, documents, chunks, jobs, tasks, rules and sensors.

Tables are columnar files, so changes are pure functions from old tables to new ones. Listings
are ordered newest first with the id as tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.model import LIFECYCLE_STATUSES, SENSOR_STATUSES, TIME_STATUSES, VERIFICATION_STATUSES
from gaugeflow.operators import layout

PAGE = 100
PAGE_MAX = 1000


def newest(rows: DataFrame, at: str = "created_at") -> DataFrame:
    return rows.orderBy(F.desc(at), "id")


# Rules


def rules_page(rules: DataFrame, collection_id: int, limit: int = PAGE, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be 1 to {PAGE_MAX} and offset at least 0")
    return newest(rules.where(F.col("collection_id") == collection_id)).offset(offset).limit(limit)


def rules_by(rules: DataFrame, **equal) -> DataFrame:
    """Rules of a document, task, or collection and type: ``rules_by(rules, document_id=3)``."""
    for column, value in equal.items():
        rules = rules.where(F.col(column) == value)
    return newest(rules)


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("collection_id").agg(F.count(F.lit(1)).alias("total_rules"))


def rule_stats(rules: DataFrame) -> DataFrame:
    """Rows (collection_id, kind, key, rules, latest): total, per type and per document.

    Rows rather than maps: a collection may hold most of the documents, and a map of them would
    be one value.
    """
    kinds = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("key")),
        F.struct(F.lit("type").alias("kind"), F.coalesce("rule_type", F.lit("unclassified")).alias("key")),
        F.struct(F.lit("document").alias("kind"), F.col("document_id").cast("string").alias("key")),
    )
    return (
        rules.select("collection_id", "created_at", F.inline(kinds))
        .groupBy("collection_id", "kind", "key")
        .agg(F.count(F.lit(1)).alias("rules"), F.max("created_at").alias("latest"))
    )


def active(rules: DataFrame) -> DataFrame:
    return rules.where("lifecycle_status <> 'superseded'")


def active_of_job(rules: DataFrame, tasks: DataFrame, job_id: int | None = None) -> DataFrame:
    """Active rules of one processing job, or of every job with its job_id."""
    own = tasks if job_id is None else tasks.where(F.col("job_id") == job_id)
    return active(rules).join(own.select(F.col("id").alias("task_id"), "job_id"), "task_id")


def mark_superseded(rules: DataFrame, ids: DataFrame) -> DataFrame:
    marked = rules.join(ids.select("id").distinct().withColumn("_marked", F.lit(True)), "id", "left")
    return marked.withColumn(
        "lifecycle_status", F.when(F.col("_marked"), F.lit("superseded")).otherwise(F.col("lifecycle_status"))
    ).drop("_marked")


def marked_count(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids, "id", "left_semi").agg(F.count(F.lit(1)).alias("marked"))


def by_ids(rows: DataFrame, ids: DataFrame, *order: str) -> DataFrame:
    return rows.join(ids, "id", "left_semi").orderBy(*(order or ("id",)))


def placed(context: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Context of tasks with the preview of each chunk and the name of its document, as ``rule_detail`` wants them.

    Names meet the chunks before these meet the context, which has several rows per chunk. Written once to the shared
    folder: a step of its own, whose shuffles are gone when rules come in.
    """
    names = documents.select(F.col("id").alias("document_id"), F.col("filename").alias("document_filename"))
    texts = chunks.select(F.col("id").alias("chunk_id"), "document_id", "content_preview").join(names, "document_id", "left").drop("document_id")
    return layout.settled(context.join(texts, "chunk_id", "left"), "context")


def rule_detail(rules: DataFrame, documents: DataFrame, chunks: DataFrame, context: DataFrame, searches: DataFrame) -> DataFrame:
    """Rules with document name, chunk index, ranked context chunks and ranked searches.

    Context and searches are gathered per rule before they meet it; a rule has as many as the
    retrieval depth and the search limit allow. Context that was ``placed`` has its texts. With the task_id of
    ``provenance`` all meet by task, as context and searches lie already, and the rules with their names and places, of
    which only the columns wanted should be given, are written once to the shared folder before.
    """
    names = documents.select(F.col("id").alias("document_id"), F.col("filename").alias("document_filename"))
    places = chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "content_preview")
    entry = F.struct("rank", "chunk_id", "relevance_score", "content_preview", "document_filename")
    by_task = "task_id" in context.columns and "task_id" in searches.columns
    key = ["task_id", "rule_id"] if by_task else ["rule_id"]
    if "content_preview" not in context.columns:
        context = context.join(places, "chunk_id", "left").join(names, "document_id", "left")
    context_lists = context.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("context_chunks"))
    search_lists = searches.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("search_rank", "search_query", "search_results"))).alias("grounding_searches")
    )
    detail = (
        rules.withColumnRenamed("id", "rule_id")
        .join(names, "document_id", "left")
        .join(places.select("chunk_id", "chunk_index"), "chunk_id", "left")
    )
    if not by_task:
        return detail.join(context_lists, "rule_id", "left").join(search_lists, "rule_id", "left")
    detail = layout.settled(detail, "rules")
    for lists in (context_lists, search_lists):
        lists = lists.withColumnsRenamed({"task_id": "_task", "rule_id": "_rule"})
        # not an equality of rules: as a key of the join it would have all of it shuffled anew
        own = (F.col("rule_id") >= F.col("_rule")) & (F.col("rule_id") <= F.col("_rule"))
        detail = detail.join(lists, (F.col("task_id") == F.col("_task")) & own, "left").drop("_task", "_rule")
    return detail


def issues(rules: DataFrame) -> DataFrame:
    """Per collection: all, active, verified, with sensor issues, with syntax errors."""
    live = F.col("lifecycle_status") != "superseded"
    return rules.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if(live).alias("active_rules"),
        F.count_if(live & (F.col("verification_status") == "ok")).alias("verified"),
        F.count_if(live & (F.col("sensor_parsing_status") == "sensors_not_found")).alias("sensor_issues"),
        F.count_if(live & (F.col("verification_status") == "syntax_error")).alias("syntax_errors"),
    )


STATUS_COLUMNS = {
    "sensor_parsing_status": (SENSOR_STATUSES, "ok"),
    "time_parsing_status": (TIME_STATUSES, "ok"),
    "verification_status": (VERIFICATION_STATUSES, "ok"),
    "lifecycle_status": (LIFECYCLE_STATUSES, "extracted"),
}
REQUIRED = ("task_id", "collection_id", "document_id", "chunk_id", "rule_name", "rule_description", "rule_reasoning", "rule_source", "rule_body_original", "rule_body")


def prepare_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules ready to append, rejected): defaults filled in, status words lower-cased and checked."""
    have = set(rules.columns)

    def given(column: str, default) -> Column:
        return F.coalesce(F.col(column), F.lit(default)) if column in have else F.lit(default)

    filled = rules.withColumns(
        {c: F.lower(given(c, default)) for c, (_, default) in STATUS_COLUMNS.items()} | {"is_consolidated": given("is_consolidated", False)}
    )
    if "consolidated_from_ids" in have:
        filled = filled.withColumn("consolidated_from_ids", F.coalesce("consolidated_from_ids", F.array().cast("array<bigint>")))
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED if c in have] + [F.lit(c) for c in REQUIRED if c not in have]
    unknown = [F.when(~F.col(c).isin(list(words)), F.lit(c)) for c, (words, _) in STATUS_COLUMNS.items()]
    checked = filled.withColumn("errors", F.filter(F.array(*missing, *unknown), lambda e: e.isNotNull()))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def append_rules(table: DataFrame, ready: DataFrame) -> DataFrame:
    return table.unionByName(ready, allowMissingColumns=True)


def provenance(rules: DataFrame, context: DataFrame, searches: DataFrame, by_task: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rule x context chunk, rule x search) rows; what a task retrieved belongs to each of its rules.

    ``context``: task_id, chunk_id?, relevance_score, rank, and the texts of ``placed``, if it was. Chunks without an id are
    not kept. With ``by_task`` the rows keep their task_id.
    """
    own = rules.select(F.col("id").alias("rule_id"), "task_id")
    key = ["task_id", "rule_id"] if by_task else ["rule_id"]
    texts = [c for c in ("content_preview", "document_filename") if c in context.columns]
    chunks = own.join(context.where("chunk_id is not null"), "task_id").select(*key, "chunk_id", "relevance_score", "rank", *texts)
    found = own.join(searches, "task_id").select(*key, "search_query", "search_results", "search_rank")
    return chunks, found


# Collections, documents and chunks


def document_counts(collections: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every collection with its number of documents and of chunks, zero included."""
    per_document = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    per_collection = (
        documents.select(F.col("id").alias("document_id"), "collection_id")
        .join(per_document, "document_id", "left")
        .groupBy("collection_id")
        .agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
    )
    return collections.select(F.col("id").alias("collection_id")).join(per_collection, "collection_id", "left").na.fill(
        0, ["documents", "chunks"]
    )


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return documents.select(F.col("id").alias("document_id")).join(counts, "document_id", "left").na.fill(0, ["chunks"])


def chunk_listing(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks in reading order with the name of their document and the length of their preview."""
    names = documents.select(F.col("id").alias("document_id"), "collection_id", F.col("filename").alias("document_filename"))
    return (
        chunks.join(names, "document_id")
        .withColumn("preview_length", F.length("content_preview"))
        .orderBy("document_id", "chunk_index", "id")
    )


def new_collections(collections: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted collections whose name is free, with their slug; a name wanted twice goes to the first."""
    first = wanted.groupBy("name").agg(F.min_by("description", "position").alias("description"))
    free = first.join(collections.select("name"), "name", "left_anti")
    slug = F.concat(F.lit("collection_"), F.replace(F.lower("name"), F.lit(" "), F.lit("_")))
    return free.withColumn("slug", slug)


# Which rows go with which, by key; and keys that are set to null instead.
CASCADES = {
    "documents": {"collection_id": "collections"},
    "sensors": {"collection_id": "collections"},
    "processing_jobs": {"collection_id": "collections"},
    "consolidation_jobs": {"collection_id": "collections", "processing_job_id": "processing_jobs"},
    "chunks": {"document_id": "documents"},
    "processing_tasks": {"job_id": "processing_jobs", "chunk_id": "chunks"},
    "rules": {"collection_id": "collections", "document_id": "documents", "chunk_id": "chunks", "task_id": "processing_tasks"},
    "rule_context_chunks": {"rule_id": "rules", "chunk_id": "chunks"},
    "rule_grounding_searches": {"rule_id": "rules"},
}
LOOSENED = {"rules": {"consolidation_job_id": "consolidation_jobs"}}
HAVE_CHILDREN = {parent for keys in [*CASCADES.values(), *LOOSENED.values()] for parent in keys.values()}


def delete_collections(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the collections in ``ids`` and everything below them.

    A row goes when one of its parents goes; a rule that stays forgets a consolidation job that
    went; a null key has no parent. What travels down is the removed ids, each level's written once
    to the shared folder, so a table is read for its keys and once more for what stays of it.
    """
    gone = {"collections": ids.select("id")}
    left = {"collections": tables["collections"].join(gone["collections"], "id", "left_anti")}

    def marked(rows: DataFrame, keys: dict[str, str]) -> tuple[DataFrame, Column, list[str]]:
        known = {key: parent for key, parent in keys.items() if parent in gone and key in rows.columns}
        dead = F.lit(False)
        for key, parent in known.items():
            rows = rows.join(gone[parent].select(F.col("id").alias(key), F.lit(True).alias(f"_gone_{key}")), key, "left")
            dead = dead | F.coalesce(f"_gone_{key}", F.lit(False))
        return rows, dead, [f"_gone_{key}" for key in known]

    for name, keys in CASCADES.items():
        if name not in tables:
            continue
        order = tables[name].columns
        rows, dead, _ = marked(tables[name], keys)
        if name in HAVE_CHILDREN:
            gone[name] = layout.stored(rows.where(dead).select("id"), f"gone-{name}")
        rows = rows.where(~dead)
        for key, parent in LOOSENED.get(name, {}).items():
            rows, lost, marks = marked(rows, {key: parent})
            rows = rows.withColumn(key, F.when(~lost, F.col(key))) if marks else rows
        left[name] = rows.select(*[f"`{c}`" for c in order])
    return left


# Jobs and tasks


def create_tasks(chunks: DataFrame, job_id: int, at: Column | None = None) -> DataFrame:
    """One pending task per chunk; the job's total is their count."""
    return chunks.select(
        F.lit(job_id).cast("bigint").alias("job_id"),
        F.col("id").alias("chunk_id"),
        F.lit("pending").alias("status"),
        (F.current_timestamp() if at is None else at).alias("created_at"),
    )


def job_progress(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Jobs with counters, status and progress in percent, from the states of their tasks."""

    def having(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    counts = tasks.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_chunks"),
        having("completed").alias("completed_chunks"),
        having("failed").alias("failed_chunks"),
        having("running").alias("running"),
    )
    counters = ["total_chunks", "completed_chunks", "failed_chunks", "running"]
    kept = [c for c in jobs.columns if c not in counters]
    joined = jobs.select(*kept).join(counts, jobs["id"] == counts["job_id"], "left").drop("job_id").na.fill(0, counters)
    done = F.col("completed_chunks") + F.col("failed_chunks")
    status = (
        F.when((F.col("total_chunks") > 0) & (done == F.col("total_chunks")), F.when(F.col("completed_chunks") == 0, F.lit("failed")).otherwise(F.lit("completed")))
        .when((F.col("status") == "pending") & (F.col("running") > 0), F.lit("running"))
        .otherwise(F.col("status"))
    )
    progress = F.coalesce(F.try_divide(done, F.col("total_chunks")) * 100, F.lit(0.0))
    return joined.withColumns({"status": status, "progress_percentage": progress}).drop("running")


def latest_status(changes: DataFrame, key: str, at: str = "at", tie: str | None = None) -> DataFrame:
    """State of each key from its log of changes (status, at, error?, result?).

    The last change wins, and of changes at one time the one with the greatest ``tie``; without a
    tie column the greatest status decides, so the answer does not depend on the order of rows. It started at its first running change and ended at its last final one.
    """
    final = F.col("status").isin("completed", "failed")

    def order(value: Column) -> Column:
        return F.struct(F.col(at), value if tie is None else F.col(tie))

    columns = [
        F.max_by("status", order(F.col("status"))).alias("status"),
        F.max(at).alias("last_change"),
        F.min(F.when(F.col("status") == "running", F.col(at))).alias("started_at"),
        F.max(F.when(final, F.col(at))).alias("completed_at"),
    ]
    for kept in ("error", "result"):
        if kept in changes.columns:
            columns.append(F.max_by(kept, F.when(F.col(kept).isNotNull(), order(F.col(kept)))).alias(kept))
    return changes.groupBy(key).agg(*columns)


def durations(jobs: DataFrame) -> DataFrame:
    """Jobs plus how long they took, in seconds."""
    seconds = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return jobs.withColumn("duration_seconds", seconds / F.lit(1_000_000))


def finalize_job(jobs: DataFrame, job_id: int, summary: DataFrame, at: Column | None = None) -> DataFrame:
    """Jobs with the counters of one consolidation, a table of one row, in the row of that job."""
    names = {
        "input_rules_count": "input_count",
        "output_rules_count": "output_count",
        "rules_removed": "remove_count",
        "rules_merged": "merge_count",
        "rules_simplified": "simplify_count",
    }
    told = summary.select(F.struct("*").alias("told")).scalar()  # one value: no join, and an error if the table has more rows
    here = (F.col("id") == job_id) & told.isNotNull()
    new = {target: F.when(here, told[source].cast("bigint")).otherwise(F.col(target)) for target, source in names.items()}
    new["consolidation_summary"] = F.when(here, F.to_json(told)).otherwise(F.col("consolidation_summary"))
    new["status"] = F.when(here, F.lit("completed")).otherwise(F.col("status"))
    new["completed_at"] = F.when(here, F.current_timestamp() if at is None else at).otherwise(F.col("completed_at"))
    return jobs.withColumns(new)


# Sensors


def sensors_of(sensors: DataFrame, collection_id: int) -> DataFrame:
    return sensors.where(F.col("collection_id") == collection_id).orderBy("sensor_id")


def sensor(sensors: DataFrame, collection_id: int, sensor_id: str) -> DataFrame:
    return sensors.where((F.col("collection_id") == collection_id) & (F.col("sensor_id") == sensor_id))


def sensor_counts(sensors: DataFrame) -> DataFrame:
    return sensors.groupBy("collection_id").agg(F.count(F.lit(1)).alias("sensors"))
