import corpus_pipeline
import __spark_entry__ as entry
from gaugeflow.llm import queries
from llm_rows import frame, odd_rows


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES} and set(queries.QUERIES) | {"pipeline"} <= names


def test_stages_keep_the_columns(spark, odd, nothing, data, tmp_path):
    for start in (odd, nothing):
        docs = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, data)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.dtypes == start.dtypes
            path = str(tmp_path / f"{start.count()}-{i}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.where("NOT round_trip").count() == 0


def test_near_duplicates_keep_one_of_each_group(spark, data):
    rows = odd_rows()
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), data).collect()]
    assert 0 in kept and 100 not in kept and 3 in kept and len(kept) == len(set(kept))


def test_whole_run(spark):
    folder = "/root/testdata/sf0.001"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    told = corpus_pipeline.run(spark, folder).collect()
    assert told and all(r.round_trip for r in told)
    kept = {r.doc_id for r in told}
    assert len([k for k in kept if labels.get(k) == 0]) <= 2
