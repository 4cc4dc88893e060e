"""Document records: what is known of a file or a text before it is cut into chunks."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from importlib import import_module
from multiprocessing.pool import ThreadPool

from pyspark import RDD, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A longer file is read and hashed in pieces of so many bytes, each by a task of its own.
PIECE_BYTES = 128 << 20
# Bytes kept for the state of a hash, of which OpenSSL uses 112.
STATE_BYTES = 256

# Media types by file extension.
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "md": "text/markdown",
    "txt": "text/plain",
    "html": "text/html",
    "csv": "text/csv",
}


def mime_type(filename: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in MIME.items() for v in pair])
    extension = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    return F.coalesce(F.try_element_at(table, extension), F.lit("application/octet-stream"))


def _empty_files(spark: SparkSession, path: str, glob: str) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop.Path(folder, glob))
    return [f.getPath().toString() for f in listed or [] if f.isFile() and f.getLen() == 0]


def _sha256() -> ctypes.CDLL | None:
    """The OpenSSL that hashlib uses: the state of its SHA-256, unlike that of hashlib's objects, can go from task to task. None where it is out of reach."""
    try:
        library = ctypes.CDLL(import_module("_hashlib").__file__)
        library.SHA256_Init.argtypes = (ctypes.c_char_p,)
        library.SHA256_Update.argtypes = (ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t)
        library.SHA256_Final.argtypes = (ctypes.c_char_p, ctypes.c_char_p)
    except (ImportError, OSError, AttributeError):
        return None
    return library


def _carry_on(state: bytes, at: int) -> Callable[[Iterable[tuple[int, bytes]]], Iterator[tuple[bytes, int]]]:
    """What takes the hash of a file's first `at` bytes over the records that follow."""

    def run(records: Iterable[tuple[int, bytes]]) -> Iterator[tuple[bytes, int]]:
        library, held, done = _sha256(), ctypes.create_string_buffer(state, STATE_BYTES), at
        for position, body in records:
            if position != done:
                raise ValueError(f"bytes at {position} follow those up to {done}")
            library.SHA256_Update(held, bytes(body), len(body))
            done += len(body)
        yield held.raw, done

    return run


def _escaped(path: str) -> str:
    """The path as a pattern of that file alone."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _records(spark: SparkSession, path: str, size: int, record: int) -> RDD:
    """(position, bytes) of a file's records of so many bytes, in partitions of so many bytes."""
    conf = {
        "mapreduce.input.fileinputformat.inputdir": re.sub(r"([\\,])", r"\\\1", _escaped(path)),
        "mapreduce.input.fileinputformat.split.minsize": str(size),
        "mapreduce.input.fileinputformat.split.maxsize": str(size),
        "fixedlengthinputformat.record.length": str(record),
    }
    kinds = ("mapreduce.lib.input.FixedLengthInputFormat", "io.LongWritable", "io.BytesWritable")
    return spark.sparkContext.newAPIHadoopRDD(*[f"org.apache.hadoop.{kind}" for kind in kinds], conf=conf)


def _pieces(spark: SparkSession, path: str) -> Iterator[tuple[RDD, int]]:
    """All of a file in order, as partitions of records.

    The last partition may end within a record, which Hadoop refuses to read; it is cut finer, at last into single bytes.
    """
    start = 0
    for size, record in ((PIECE_BYTES, PIECE_BYTES >> 7), (PIECE_BYTES >> 4, PIECE_BYTES >> 11), (PIECE_BYTES >> 8, PIECE_BYTES >> 15), (PIECE_BYTES >> 8, 1)):
        records = _records(spark, path, size, record)
        end = records.getNumPartitions() - (record > 1)
        yield from ((records, i) for i in range(start // size, end))
        start = end * size


def _hash_in_pieces(spark: SparkSession, path: str, length: int) -> str:
    """SHA-256 of a file: a task reads one piece and hands the state of the hash to the task of the next."""
    library, state, done = _sha256(), ctypes.create_string_buffer(STATE_BYTES), 0
    library.SHA256_Init(state)
    state = state.raw
    for records, i in _pieces(spark, path):
        ((state, done),) = spark.sparkContext.runJob(records, _carry_on(state, done), [i])
    if done != length:
        raise ValueError(f"{path} has {length} bytes, {done} were read")
    digest = ctypes.create_string_buffer(32)
    library.SHA256_Final(digest, ctypes.create_string_buffer(state, STATE_BYTES))
    return digest.raw.hex()


def _hash_long_files(spark: SparkSession, files: list[tuple[str, int]]) -> list[tuple[str, int, str]]:
    """path, length, content_hash of each; the files side by side, the pieces of one in turn."""
    if not files:
        return []
    runs = [inheritable_thread_target(partial(_hash_in_pieces, spark, *file)) for file in files]
    with ThreadPool(min(len(files), spark.sparkContext.defaultParallelism)) as pool:
        hashes = pool.map(lambda run: run(), runs, chunksize=1)
    return [(*file, content_hash) for file, content_hash in zip(files, hashes)]


def _readable_in_pieces(spark: SparkSession, path: str) -> bool:
    """Whether the state of a hash can be handed on here, and Hadoop would not unpack the file for its name, such as `.gz`."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop
    codecs = jvm.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    return _sha256() is not None and codecs.getCodec(jvm.fs.Path(path)) is None


def ingest_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """filename, file_path, content_hash, file_size, mime_type, sync_status of every file, empty ones too.

    The scan passes over files of no bytes; those are taken from the folder's listing. Files of more than
    PIECE_BYTES are hashed piece by piece when this is called, but for packed ones (`.gz` and the like): those are
    read whole by a task each, as the others are.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")
    long = [(f.path, f.length) for f in files.where(F.col("length") > PIECE_BYTES).select("path", "length").collect()]
    pieced = [f for f in long if _readable_in_pieces(spark, f[0])]
    packed = [_escaped(f[0]) for f in long if f not in pieced]
    files = files.where(F.col("length") <= PIECE_BYTES)
    if packed:
        files = files.unionByName(spark.read.format("binaryFile").load(packed).select("path", "length", "content"))
    empty = [(name, 0, bytearray()) for name in _empty_files(spark, path, glob)]
    files = files.unionByName(spark.createDataFrame(empty, "path string, length bigint, content binary"))
    hashed = files.select("path", "length", F.sha2("content", 256).alias("content_hash"))
    hashed = hashed.unionByName(spark.createDataFrame(_hash_long_files(spark, pieced), "path string, length bigint, content_hash string"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return hashed.select(
        name.alias("filename"),
        F.col("path").alias("file_path"),
        "content_hash",
        F.col("length").alias("file_size"),
        mime_type(name).alias("mime_type"),
        F.lit("not_uploaded").alias("sync_status"),
    )


def ingest_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """The same record for documents that arrive as text, other columns kept."""
    body = F.col(text)
    return texts.withColumns(
        {"content_hash": F.sha2(body.cast("binary"), 256), "file_size": F.octet_length(body).cast("bigint"), "sync_status": F.lit("not_uploaded")}
    )
