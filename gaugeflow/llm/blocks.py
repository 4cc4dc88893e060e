"""Documents packed into blocks, and questions that all blocks ask about their distinct keys.

Statistics of keys that are as many as the text's words or bytes (n-grams, windows) are too many for one row each, and
too many to broadcast. Here a block of documents finds its own distinct keys, sends them in sorted runs to the buckets
that a hash deals the keys to, and gets back one short answer per key in the same order. A key of any frequency is one
entry per block, so no bucket grows with a key's frequency.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import arrays
from gaugeflow.llm.shared import ensure_checkpoint_dir

BLOCK_BYTES = 8 << 20
LEAST_BUCKETS = 48
ASKED = "kind int, bucket int, block long, payload binary"


def _packer(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, task = [], 0, 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "payload"])

        for batch in batches:
            _, offsets = arrays.flat(batch.column(batch.num_columns - 1))
            for a, b in arrays.chunks(offsets, block_bytes):
                if size and size + int(offsets[b] - offsets[a]) > block_bytes:
                    yield close()
                    held, size, number = [], 0, number + 1
                held.append(batch.slice(a, b - a))
                size += int(offsets[b] - offsets[a])
        if held:
            yield close()

    return run


def packed(docs: DataFrame, columns: list, block_bytes: int = BLOCK_BYTES, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """(block, payload): the given columns, the text last, of consecutive documents of about block_bytes of text.

    Blocks are dealt by their number and kept (in memory or on disk), so that every later question finds them in place;
    a lost one is packed again from the same rows. release(spark) gives them up, once what was made of them is written.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = docs.select(*columns).mapInArrow(_packer(block_bytes), "block long, payload binary").repartition(parts, "block").persist(level)
    _held(docs.sparkSession).append(blocks)
    return blocks


def _held(spark: SparkSession) -> list[DataFrame]:
    return vars(spark.sparkContext).setdefault("gaugeflow_blocks", [])  # not in a module: functions are pickled with theirs


def release(spark: SparkSession) -> None:
    """Give up the blocks of all operators whose results are no longer to be computed."""
    while held := _held(spark):
        held.pop().unpersist()


def unpacked(payload: pa.Scalar | bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload.as_py() if isinstance(payload, pa.Scalar) else payload)).read_all()


def squeezed(*values: np.ndarray) -> bytes:
    """Arrays of one length, byte planes apart, compressed. Ascending unsigned integers should come as differences."""
    planes = [np.frombuffer(x.tobytes(), np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"" for x in values]
    return zstandard.compress(b"".join([np.int64(len(values[0])).tobytes(), *planes]), 1)


def restored(payload: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.decompress(payload)
    n, at, out = int(np.frombuffer(data[:8], np.int64)[0]), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += n * width
    return out


def differences(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def dealt(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, last) of ascending 64-bit keys; bucket by the key's high bits."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(b, cuts[b], cuts[b + 1]) for b in range(buckets) if cuts[b + 1] > cuts[b]]


def bits(flags: np.ndarray) -> bytes:
    return squeezed(np.packbits(flags))


def flags(payload: bytes, n: int) -> np.ndarray:
    return np.unpackbits(restored(payload, "u1")[0], count=n).astype(bool)


Answers = dict[tuple[int, int], bytes]


def asked(blocks: DataFrame, question: Callable[[pa.Table, Answers], Iterator[tuple[int, int, bytes]]], answers: DataFrame | None = None) -> DataFrame:
    """question(documents, answers so far) of every block yields (kind, bucket, payload)."""
    return _each(blocks, lambda block, table, told: _rows(block, question(table, told)), ASKED, answers)


def _rows(block: int, found: Iterator[tuple[int, int, bytes]]) -> pa.Table:
    kind, bucket, payload = [list(x) for x in zip(*found)] or ([], [], [])
    return pa.table([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array([block] * len(kind), pa.int64()), pa.array(payload, pa.binary())], ["kind", "bucket", "block", "payload"])


def _each(blocks: DataFrame, work: Callable[[int, pa.Table, Answers], pa.Table], schema: str, answers: DataFrame | None) -> DataFrame:
    if answers is None:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from work(block, unpacked(payload), {}).to_batches()

        return blocks.mapInArrow(scan, schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        told = dict(zip(zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist()), right.column("payload").to_pylist()))
        pa.default_memory_pool().release_unused()
        parts = [work(block, unpacked(payload), told) for block, payload in zip(left.column("block").to_pylist(), left.column("payload").combine_chunks())]
        return pa.concat_tables(parts) if parts else empty

    empty = pa.schema([(f.name, t) for f, t in _arrow_fields(blocks, schema)]).empty_table()
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)


def _arrow_fields(df: DataFrame, schema: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [(f, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]


def finished(blocks: DataFrame, work: Callable[[pa.Table, Answers], pa.Table], schema: str, answers: DataFrame) -> DataFrame:
    """work(documents, all answers) of every block."""
    return _each(blocks, lambda _, table, told: work(table, told), schema, answers)


def answered(questions: DataFrame, answer: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """For every kind and bucket, answer(kind, payloads) gives each block its payload back; settled in the shared folder."""
    ensure_checkpoint_dir(questions.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        told = answer(kind, table.column("payload").to_pylist())
        pa.default_memory_pool().release_unused()
        return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array(told, pa.binary())).select(["kind", "bucket", "block", "payload"])

    return questions.groupBy("kind", "bucket").applyInArrow(run, ASKED).checkpoint()


def bucket_count(blocks: DataFrame) -> int:
    """Buckets for the questions of these blocks: about one for two blocks, so that a bucket's size does not grow with the input."""
    return max(LEAST_BUCKETS, blocks.agg(F.count("*")).first()[0] // 2)
