import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import catalog as ct
from gaugeflow.operators import layout
from gaugeflow.operators import rules as ru
from gaugeflow.plans import catalog_queries
from gaugeflow.sources import readings as rd
from gaugeflow.sources import rules as sr
from gaugeflow.sources import sinks
from gaugeflow.model import Rule


@pytest.fixture(scope="module")
def rules(spark):
    rows = [
        (i, i % 2, 10 + i % 3, f"r{i}", "superseded" if i in (4, 7) else "extracted", "ok" if i != 2 else "syntax_error", i * 1000)
        for i in range(8)
    ]
    df = spark.createDataFrame(
        rows, "id bigint, collection_id int, task_id int, rule_name string, lifecycle_status string, verification_status string, at bigint"
    )
    texts = {c: F.lit("t") for c in sr.LOADED if c not in df.columns}
    return df.withColumns(texts).withColumn("created_at", F.timestamp_millis("at"))


def names(df):
    return [r.rule_name for r in df.collect()]


def test_loading(rules):
    assert names(sr.load_rules(rules, collection_id=0)) == ["r6", "r0"]
    assert names(sr.load_rules(rules, collection_id=0, parity=True)) == ["r6", "r4", "r0"]
    assert names(sr.load_rules(rules, collection_id=0, limit=2)) == ["r6"]
    assert sorted(names(sr.load_rules(rules, task_id=11, collection_id=0))) == ["r1"]
    assert sorted(names(sr.load_all(rules, limit=2))) == ["r5", "r6"]
    with pytest.raises(ValueError):
        sr.load_rules(rules)


def test_newest_are_cut_before_the_shuffle(rules):
    plan = sr.load_all(rules, limit=1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_rules_in_a_program(spark):
    df = sr.from_dicts(spark, [{"rule_name": "a", "rule_body": "b"}])
    assert tuple(df.first()) == (0, "a", "", "b")


def test_pages(rules):
    assert names(ct.rules_page(rules, 1, 2, 1)) == ["r5", "r3"]
    for limit, offset in ((0, 0), (1001, 0), (10, -1)):
        with pytest.raises(ValueError):
            ct.rules_page(rules, 1, limit, offset)


def test_job_progress(spark):
    jobs = spark.createDataFrame([(i, "pending") for i in range(1, 6)], "id bigint, status string")
    states = {1: ["completed", "failed"], 2: ["failed", "failed"], 3: ["running", "pending"], 4: ["pending", "completed"]}
    tasks = spark.createDataFrame([(j, s) for j, all_ in states.items() for s in all_], "job_id bigint, status string")
    got = {r.id: (r.status, r.progress_percentage) for r in ct.job_progress(jobs, tasks).collect()}
    assert got == {1: ("completed", 100.0), 2: ("failed", 100.0), 3: ("running", 0.0), 4: ("pending", 50.0), 5: ("pending", 0.0)}


def test_status_log(spark):
    changes = spark.createDataFrame(
        [(1, "pending", 1, None), (1, "running", 2, None), (1, "failed", 3, "x"), (1, "running", 4, None), (1, "completed", 5, None), (2, "pending", 1, None)],
        "task_id bigint, status string, at bigint, error string",
    )
    got = {r.task_id: tuple(r)[1:] for r in ct.latest_status(changes, "task_id").collect()}
    assert got == {1: ("completed", 5, 2, 5, "x"), 2: ("pending", 1, None, None, None)}
    tied = changes.where("task_id = 1").withColumn("line", -F.col("at")).withColumn("at", F.lit(1))
    assert ct.latest_status(tied, "task_id", tie="line").first().status == "pending"
    assert ct.latest_status(tied, "task_id").first().status == "running"


def test_append(spark, rules):
    new = spark.createDataFrame([(9, "New", "NO_SENSORS")], "collection_id int, rule_name string, sensor_parsing_status string")
    ready, rejected = ct.prepare_rules(new)
    assert ready.count() == 0 and "task_id" in rejected.first().errors
    full = new.withColumns({c: F.lit("1") for c in ct.REQUIRED if c not in new.columns})
    ready, rejected = ct.prepare_rules(full)
    row = ready.first()
    assert rejected.count() == 0 and (row.sensor_parsing_status, row.lifecycle_status, row.is_consolidated) == ("no_sensors", "extracted", False)


def test_cascade(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    left = ct.delete_collections(
        table([(1,)], "id bigint"),
        {
            "collections": table([(1,), (2,)], "id bigint"),
            "documents": table([(10, 1), (20, 2)], "id bigint, collection_id bigint"),
            "chunks": table([(100, 10), (200, 20)], "id bigint, document_id bigint"),
            "rules": table([(1, 2, 20, 200), (2, 2, 20, 100)], "id bigint, collection_id bigint, document_id bigint, chunk_id bigint"),
            "rule_context_chunks": table([(1, 1, 200), (2, 2, 200), (3, 1, 100)], "id bigint, rule_id bigint, chunk_id bigint"),
        },
    )
    assert {name: sorted(r.id for r in df.collect()) for name, df in left.items()} == {
        "collections": [2], "documents": [20], "chunks": [200], "rules": [1], "rule_context_chunks": [1],
    }


def test_cascade_over_all_tables(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    left = ct.delete_collections(
        table([(1,)], "id bigint"),
        {
            "collections": table([(1,), (2,)], "id bigint"),
            "documents": table([(10, 1), (20, 2), (30, None)], "id bigint, collection_id bigint"),
            "sensors": table([(1, 1), (2, 2)], "id bigint, collection_id bigint"),
            "processing_jobs": table([(5, 1), (6, 2)], "id bigint, collection_id bigint"),
            "consolidation_jobs": table([(7, 1, None), (8, 2, 5), (9, 2, 6)], "id bigint, collection_id bigint, processing_job_id bigint"),
            "chunks": table([(100, 10), (200, 20)], "id bigint, document_id bigint"),
            "processing_tasks": table([(1, 6, 200), (2, 5, 200), (3, 6, 100)], "id bigint, job_id bigint, chunk_id bigint"),
            "rules": table(
                [(1, 2, 20, 200, 1, 8), (2, 2, 20, 200, 2, 9), (3, 2, 20, 200, 1, 9), (4, 2, None, None, None, None)],
                "id bigint, collection_id bigint, document_id bigint, chunk_id bigint, task_id bigint, consolidation_job_id bigint",
            ),
            "rule_context_chunks": table([(1, 1, 200), (2, 2, 200)], "id bigint, rule_id bigint, chunk_id bigint"),
            "rule_grounding_searches": table([(1, 3), (2, 2)], "id bigint, rule_id bigint"),
        },
    )
    assert {name: sorted(r.id for r in df.collect()) for name, df in left.items()} == {
        "collections": [2], "documents": [20, 30], "sensors": [2], "processing_jobs": [6], "consolidation_jobs": [9], "chunks": [200],
        "processing_tasks": [1], "rules": [1, 3, 4], "rule_context_chunks": [1], "rule_grounding_searches": [1],
    }
    assert {r.id: r.consolidation_job_id for r in left["rules"].collect()} == {1: None, 3: 9, 4: None}


def test_csv_sink_appends(spark, tmp_path):
    readings = rd.from_wide(spark.sql("SELECT timestamp_seconds(id) AS ts, double(id) AS s FROM range(5)"))
    events = ru.check(readings, [Rule("high", lambda s: s.get("s", "0") > 2, "high", "d")])
    path = str(tmp_path / "events")
    for mode in ("overwrite", "append"):
        sinks.write_csv(events, path, mode)
    back = sinks.read_csv(spark, path).collect()
    assert len(back) == 4 and {r.sensor_values["s"] for r in back} == {3.0, 4.0} and back[0].explanation == "Rule 'high' returned: high"
    sinks.write_csv(events, path)
    assert sinks.read_csv(spark, path).count() == 2


def detail_tables(spark):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    rules = [(1, 10, 1, 100, "a"), (2, 10, 1, 101, "b"), (3, 11, 9, 999, "no document, no chunk"), (4, None, 2, 200, "no task"), (5, 12, None, None, "nothing"), (6, 13, 2, 201, "no context")]
    context = [(10, 101, 0.5, 2), (10, 100, 0.9, 1), (10, 200, 0.5, 2), (11, 888, 0.1, 1), (11, None, 0.2, 2), (12, 201, 0.3, 1), (14, 100, 0.3, 1), (None, 100, 0.3, 1)]
    return (
        made(rules, "id bigint, task_id bigint, document_id bigint, chunk_id bigint, rule_name string"),
        made([(1, "one.md"), (2, None)], "id bigint, filename string"),
        made([(100, 1, 0, "p0"), (101, 1, 1, "p1"), (200, 2, 0, None), (201, 7, 0, "lost")], "id bigint, document_id bigint, chunk_index int, content_preview string"),
        made(context, "task_id bigint, chunk_id bigint, relevance_score double, rank int"),
        made([(10, "q2", "[]", 2), (10, "q1", "[]", 1), (13, "q", "[]", 1)], "task_id bigint, search_query string, search_results string, search_rank int"),
    )


def test_rule_detail_by_task_is_that_by_rule(spark):
    rules, documents, chunks, context, searches = detail_tables(spark)
    whole = ct.rule_detail(rules, documents, chunks, *ct.provenance(rules, context, searches))
    steps = ct.rule_detail(rules, documents, chunks, *ct.provenance(rules, ct.placed(context, chunks, documents), searches, by_task=True))
    shown = lambda df: {r.rule_id: r.asDict(True) for r in df.collect()}
    got = shown(steps)
    assert got == shown(whole) and len(got) == rules.count()
    assert [(e["chunk_id"], e["content_preview"], e["document_filename"]) for e in got[1]["context_chunks"]] == [(100, "p0", "one.md"), (101, "p1", "one.md"), (200, None, None)]
    assert [s["search_query"] for s in got[2]["grounding_searches"]] == ["q1", "q2"]
    assert got[4]["context_chunks"] is None and got[3]["document_filename"] is None and got[6]["chunk_index"] == 0


def test_rule_detail_moves_each_table_once(spark, data):
    # fifteen shuffles, of context alone four, lay on disk together until the query ended
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog_queries.rule_detail(spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("SortMergeJoin") == 4 and plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 4


def test_a_settled_step_leaves_no_shuffle(spark):
    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",")
        return {int(b.split("_")[1]) for b in blocks.split(",") if b.startswith("shuffle_")}

    rows = spark.range(2_000).selectExpr("id", "id % 7 as k").groupBy("k").count()
    rows.collect()
    before = max(shuffles(), default=-1)
    assert before >= 0
    told = spark.conf.get(layout.DROP_SHUFFLES, None)
    kept = layout.settled(spark.range(2_000).selectExpr("id", "id % 7 as k").groupBy("k").count(), "kept")
    assert sorted(kept.collect()) == sorted(rows.collect()) and not {x for x in shuffles() if x > before}
    assert spark.conf.get(layout.DROP_SHUFFLES, None) == told
