import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import documents as dc
from gaugeflow.operators import retrieval as rt
from gaugeflow.sources import documents as sd
from gaugeflow.sources import sensors as ss


def texts(spark):
    rng = random.Random(3)
    made = ["", "x", "y" * 1000, "z" * 1001, "é\n" * 900, "word " * 700 + "\n\n" + "tail " * 90, "😀" * 1700]
    made += ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 5000))) for _ in range(20)]
    return spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string"), made


@pytest.mark.parametrize("size,overlap", [(1000, 200), (100, 0), (100, 50)])
def test_stride_chunks(spark, size, overlap):
    df, made = texts(spark)
    got = {}
    for r in dc.chunk(df, size=size, overlap=overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.page_content)
    for number, text in enumerate(made):
        starts = range(0, max(len(text) - overlap, 1), size - overlap) if text else []
        assert got.get(number, []) == [text[s : s + size] for s in starts], number


def test_separator_chunks(spark):
    df, made = texts(spark)
    rows = dc.chunk_by_separator(df).collect()
    for number, text in enumerate(made):
        own = [r.page_content for r in sorted(rows, key=lambda r: r.chunk_index) if r.doc_id == number]
        assert all(0 < len(c) <= 1000 and c in text and c == c.strip() for c in own)
        # Every word is in a chunk; words longer than a chunk are cut.
        for word in set(text.split()):
            assert len(word) > 1000 or any(word in c for c in own)
    paragraphs = spark.createDataFrame([(1, "a" * 600 + "\n\n" + "b" * 600)], "doc_id bigint, text string")
    assert [r.page_content[0] for r in dc.chunk_by_separator(paragraphs).collect()] == ["a", "b"]


def test_outcomes(spark):
    docs = spark.createDataFrame(
        [(1, "abc", "failed"), (2, "", "not_uploaded"), (3, "x", "uploaded")], "doc_id bigint, text string, sync_status string"
    )
    done = dc.sync_outcomes(docs, dc.chunk(docs.select("doc_id", "text")))
    assert sorted((r.doc_id, r.sync_status, r.chunks) for r in done.collect()) == [(1, "uploaded", 1), (2, "failed", 0)]
    assert tuple(dc.sync_totals(done).first()) == (2, 1, 1, 1)


def test_chunk_selection(spark):
    chunks = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "chunk_id bigint, document_id bigint")
    docs = spark.createDataFrame([(1, 5), (2, 6)], "document_id bigint, collection_id bigint")
    ids = lambda df: sorted(r.chunk_id for r in df.collect())
    assert ids(dc.select_chunks(chunks, docs, 6)) == [3]
    assert ids(dc.select_chunks(chunks, docs, 6, document_ids=docs.where("document_id = 1"))) == [1, 2]
    assert ids(dc.select_chunks(chunks, docs, 6, chunk_ids=chunks.where("chunk_id = 2"))) == [2]


@pytest.mark.parametrize("bound,block", [(1000, 1000), (3, 7), (3, 1000)])
def test_top_k(spark, bound, block):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(60, 8)).round(2)
    vectors[10] = vectors[20] = vectors[30]  # equal scores go to the lower id
    asked = np.vstack([vectors[:10], vectors[30:31], np.zeros((1, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>").repartition(5)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id bigint, embedding array<double>")
    got = {}
    for r in rt.top_k(df, qs, 4, broadcast_bytes=bound, block_bytes=block, tile_bytes=256).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    scores = np.round(unit(asked) @ unit(vectors).T, 12)
    want = {q: sorted(range(60), key=lambda v, q=q: (-scores[q, v], v))[:4] for q in range(len(asked))}
    assert got == want


def test_digest(spark):
    searches = spark.createDataFrame([(1, n, f"q{n}") for n in range(1, 6)], "chunk_id bigint, search_rank int, search_query string")
    results = spark.createDataFrame(
        [(1, 1, 1, "t", "u", "x" * 300), (1, 1, 2, "t", "u", ""), (1, 1, 3, "t", "u", "third"), (1, 2, 1, "t", None, "short")],
        "chunk_id bigint, search_rank int, result_rank int, title string, url string, content string",
    )
    text = rt.search_digest(searches, results, per_search=2, max_searches=4, cut=200).first().grounding
    assert text == (
        "\n🔍 Query: q1\n  • t: " + "x" * 200 + "...\n    Source: u\n\n🔍 Query: q2\n  • t: short\n    Source: \n\n🔍 Query: q3\n\n🔍 Query: q4"
    )


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"\0")
    got = {r.filename: (r.content_hash[:8], r.file_size, r.mime_type) for r in sd.ingest_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("ba7816bf", 3, "text/markdown"), "b.bin": ("6e340b9c", 1, "application/octet-stream")}


def test_files_too_long_for_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sd, "PIECE_BYTES", 1 << 16, raising=False)
    rng = np.random.default_rng(5)
    lengths = {
        "one.bin": 1 << 16, "more.bin": (1 << 16) + 1, "odd, {a}[b]?.bin": 500_009, "odd, {a}[b]c.bin": 99_991, "even.md": 7 << 16, "slop.txt": 72_089, "none.txt": 0, "a.gz": 9,
    }
    for name, n in lengths.items():
        (tmp_path / name).write_bytes(b"\xef\xbb\xbf\n\0"[:n] + rng.bytes(max(0, n - 5)))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(1 << 16))  # as 2 GB is of itself: no row holds a longer file
    try:
        rows = sd.ingest_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    got = {r.filename: (r.content_hash, r.file_size) for r in rows}
    assert len(rows) == len(lengths)
    assert got == {name: (hashlib.sha256((tmp_path / name).read_bytes()).hexdigest(), n) for name, n in lengths.items()}
    (tmp_path / "long[1].gz").write_bytes(rng.bytes(200_000))  # not a packed file, but named as one
    (tmp_path / "long1.gz").write_bytes(rng.bytes(100_000))
    got = {r.filename: r.content_hash for r in sd.ingest_files(spark, str(tmp_path), "long*").collect()}
    assert got == {name: hashlib.sha256((tmp_path / name).read_bytes()).hexdigest() for name in ("long[1].gz", "long1.gz")}


def test_sensor_csv_and_upsert(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("id,name,description,unit,example\n a ,First,,%,1\n,none,,,\nb,,,,\na,Second, d ,,\nc,Third,,,\n")
    found = ss.read_csv(spark, str(path), 4)
    assert found.count() == 3
    target = spark.createDataFrame(
        [(4, "a", "old", "od", "ou", "oe"), (4, "z", "zn", None, "zu", None)],
        "collection_id bigint, sensor_id string, name string, description string, unit string, example string",
    )
    got = {r.sensor_id: tuple(r)[2:] for r in ss.upsert(target, found).collect()}
    assert got == {"a": ("Second", "d", None, None), "c": ("Third", None, None, None), "z": ("zn", None, "zu", None)}
    path.write_text("id,name,description,unit,example\n,none,,,\n")
    with pytest.raises(ValueError):
        ss.read_csv(spark, str(path), 4)


def test_near_top_k_is_exact_within_its_buckets(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=16)).tolist()) for i in range(800)] + [(800 + i, centres[0].tolist()) for i in range(300)] + [(2000, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = rt.top_k(vectors.where("embedding IS NOT NULL"), asked.where("embedding IS NOT NULL"), 10)
    near = rt.near_top_k(vectors, asked, 10, bits=5, free=1, tables=4, block_rows=100)  # neighbours are close: few buckets do
    assert rt.recall(near, exact).first().recall > 0.95
    score = {(r.query_id, r["rank"]): r.score for r in exact.collect()}
    assert all(r.score <= score[r.query_id, r["rank"]] + 1e-9 for r in near.collect())
    every = rt.near_top_k(vectors, asked, 10, bits=2, free=2, tables=1, block_rows=100)  # all buckets: the exact answer
    key = lambda df: sorted((r.query_id, r["rank"], round(r.score, 9)) for r in df.collect())
    assert key(every) == key(exact)
    assert rt.near_top_k(vectors.limit(0), asked).count() == 0


def test_separator_chunks_of_a_few_texts_at_a_time(spark, monkeypatch):
    df, _ = texts(spark)
    df = df.unionByName(spark.createDataFrame([(90, None)], df.schema)).coalesce(1)
    told = lambda: sorted(map(tuple, dc.chunk_by_separator(df).collect()))
    whole = told()
    monkeypatch.setattr(dc, "CUT_BYTES", 700)
    assert whole and told() == whole


def brute(asked, vectors, ids, k):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    scores = np.einsum("qd,vd->qv", unit(asked.astype("float64")), unit(vectors.astype("float64")))
    return [[ids[v] for v in sorted(range(len(ids)), key=lambda v, s=s: (-round(s[v], 12), ids[v]))[:k]] for s in scores]


@pytest.mark.parametrize("named", [int, lambda i: f"v{i:04}"])
def test_top_k_of_all_against_all_goes_to_many_tasks(spark, monkeypatch, named):
    """One file of vectors that all ask each other is no single task, and small blocks make no more copies of them."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(600, 8)).astype("float32")
    vectors[100:400] = vectors[100]  # copies: the lowest ids are told
    vectors[400:420] = vectors[400] * 2.0 ** np.arange(20)[:, None]  # the same direction
    ids = [named(int(i)) for i in rng.permutation(600)]
    kind = "bigint" if named is int else "string"
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], f"vec_id {kind}, embedding array<float>").coalesce(1)
    grids, inner = [], rt._in_grid
    monkeypatch.setattr(rt, "_in_grid", lambda *a: grids.append(a[4:6]) or inner(*a))
    want = dict(zip(ids, brute(vectors, vectors, ids, 5)))
    for how in ({"task_pairs": 40_000}, {"broadcast_bytes": 0, "block_bytes": 1, "tile_bytes": 64, "task_pairs": 40_000}, {"broadcast_bytes": 0, "cell_bytes": 200 * 64}):
        got = {}
        for r in rt.top_k(df, df.withColumnRenamed("vec_id", "query_id"), 5, **how).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want, how
    assert grids == [(3, 3)] * 3


def test_best_of_many_batches(spark):
    """Batch by batch the best stay exact, in every tile; NaN sorts first, as in Spark."""
    rng = np.random.default_rng(2)
    vectors, ids = rng.normal(size=(3000, 16)).astype("float32"), rng.permutation(3000)
    vectors[1000:1500] = vectors[:500] + rng.normal(size=(500, 16)) * 1e-4  # closer than single precision can tell
    best = rt._Best(vectors[:700], 4)
    for a, b in ((0, 2), (2, 1200), (1200, 1201), (1201, 3000)):
        best.meet(vectors[a:b], ids[a:b], tile_bytes=1 << 18)
    assert best.ids.tolist() == brute(vectors[:700], vectors, ids, 4)
    vectors[5] = np.nan
    best = rt._Best(vectors[10:12], 3)
    best.meet(vectors, ids)
    assert best.ids[:, 0].tolist() == [ids[5]] * 2 and np.isnan(best.scores[:, 0]).all() and np.isfinite(best.scores[:, 1:]).all()


def test_near_top_k_hands_on_copies_in_small_batches():
    planes = np.random.default_rng(0).normal(size=(4, 6, 64))
    rows = np.random.default_rng(1).normal(size=(1000, 64))
    batch = pa.record_batch({"id": pa.array(range(1000)), "embedding": pa.array(rows.tolist(), pa.list_(pa.float64()))})
    made = list(rt._signed(planes, 4)(iter([batch])))
    assert sum(b.num_rows for b in made) == 1000 * 4 * 16 and max(b.nbytes for b in made) < 2 * rt.COPIED_BYTES
    assert {tuple(b["embedding"][0].as_py()) for b in made} <= {tuple(r) for r in rows}
