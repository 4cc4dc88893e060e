"""Texts to chunks, and how a sync of documents went."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.model import CHUNK_OVERLAP, CHUNK_SIZE, PREVIEW_LENGTH

# Separators tried in turn by the separator-aware splitter.
SEPARATORS = ("\n\n", "\n", " ", "")
# Bytes of text a Python worker cuts at a time, or one text if it is longer.
CUT_BYTES = 1 << 20


def stride_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of windows of ``size`` characters that start every ``size - overlap``.

    One pass cuts the text into strides; a chunk is a stride and the start of the next, so long
    texts cost no more per character than short ones.
    """
    stride = size - overlap
    if overlap > stride:
        raise ValueError("overlap may be at most half the chunk size")
    strides = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))

    def cut(pieces: Column) -> Column:
        count = F.size(pieces)
        # A last stride that the chunk before it already holds makes no chunk of its own.
        count = F.when((count > 1) & (F.length(F.get(pieces, count - 1)) <= overlap), count - 1).otherwise(count)
        return F.transform(
            F.slice(pieces, F.lit(1), count),
            lambda piece, i: F.concat(piece, F.substring(F.coalesce(F.get(pieces, i + 1), F.lit("")), 1, overlap)),
        )

    return F.get(F.transform(F.array(strides), cut), F.lit(0))


def chunk(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: the document's other columns, chunk_index, page_content."""
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.posexplode(stride_chunks(F.col(text), size, overlap)).alias("chunk_index", "page_content"))


def chunk_by_separator(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks that end at paragraphs, lines or words where they can; a worker holds the chunks of CUT_BYTES of text at a time."""
    kept = [c for c in docs.columns if c != text]
    fields = [f.name for f in docs.schema.fields if f.name != text]
    at_once = CUT_BYTES
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)
    separators = SEPARATORS

    def packed(pieces: list[str]) -> Iterator[str]:
        """Neighbouring pieces joined up to ``size``, keeping at most ``overlap`` of the tail."""
        start, length = 0, 0
        for end, piece in enumerate(pieces):
            if start < end and length + len(piece) > size:
                yield "".join(pieces[start:end])
                while start < end and (length > overlap or length + len(piece) > size):
                    length -= len(pieces[start])
                    start += 1
            length += len(piece)
        if start < len(pieces):
            yield "".join(pieces[start:])

    def cut(body: str, level: int) -> Iterator[str]:
        while separators[level] and separators[level] not in body:
            level += 1
        mark = separators[level]
        if mark:
            parts = body.split(mark)
            pieces = [p for p in [parts[0], *[mark + part for part in parts[1:]]] if p]
        else:
            pieces = list(body)
        run: list[str] = []
        for piece in pieces:
            if len(piece) < size:
                run.append(piece)
                continue
            yield from packed(run)
            run = []
            if level + 1 < len(separators):
                yield from cut(piece, level + 1)
            else:
                yield piece
        yield from packed(run)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(text)
            ends = np.cumsum(pc.binary_length(bodies).fill_null(0).to_numpy(), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ends // at_once)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                row, number, content = [], [], []
                for place in range(a, b):
                    parts = (part.strip() for part in cut(bodies[place].as_py() or "", 0))
                    for n, part in enumerate(part for part in parts if part):
                        row.append(place)
                        number.append(n)
                        content.append(part)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in fields), pa.array(number, pa.int32()), pa.array(content, pa.string())], [*fields, "chunk_index", "page_content"])
            del batch, bodies
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(split, f"{head}{', ' if head else ''}chunk_index int, page_content string")


def chunk_records(chunks: DataFrame, preview: int = PREVIEW_LENGTH) -> DataFrame:
    """Chunks plus preview, hash and size."""
    content = F.col("page_content")
    return chunks.withColumns(
        {
            "content_preview": F.substring(content, 1, preview),
            "content_hash": F.sha2(content.cast("binary"), 256),
            "chunk_size": F.length(content),
        }
    )


def to_sync(documents: DataFrame) -> DataFrame:
    """Documents that still have to be processed."""
    return documents.where(F.col("sync_status").isin("not_uploaded", "failed"))


def sync_outcomes(documents: DataFrame, chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Processed documents with their chunk count; one without chunks has failed."""
    counts = chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("chunks"))
    return to_sync(documents).join(counts, doc, "left").withColumns(
        {
            "chunks": F.coalesce("chunks", F.lit(0)),
            "sync_status": F.when(F.col("chunks") > 0, F.lit("uploaded")).otherwise(F.lit("failed")),
        }
    )


def sync_totals(outcomes: DataFrame, *groups: str) -> DataFrame:
    return outcomes.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(F.col("sync_status") == "uploaded").alias("synced_documents"),
        F.count_if(F.col("sync_status") == "failed").alias("failed_documents"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"),
    )


def select_chunks(
    chunks: DataFrame, documents: DataFrame, collection_id: int, chunk_ids: DataFrame | None = None, document_ids: DataFrame | None = None
) -> DataFrame:
    """Chunks to process: those listed, else those of the listed documents, else of the collection."""
    if chunk_ids is not None:
        return chunks.join(chunk_ids, "chunk_id", "left_semi")
    if document_ids is not None:
        return chunks.join(document_ids, "document_id", "left_semi")
    own = documents.where(F.col("collection_id") == collection_id).select("document_id")
    return chunks.join(own, "document_id", "left_semi")
