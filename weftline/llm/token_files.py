"""Token-id output: concatenated ids with Elias-Fano document boundaries, in segments.

A dataset is a folder of Parquet files whose rows are segments of about ``SEGMENT_IDS`` ids: the id array
(unsigned 16-bit where the vocabulary allows, else 32-bit), the document ids and the boundaries. Segments are
in ascending document order: by range partition, then by number within it. A document never spans two segments,
so one whose ids exceed a segment makes a longer one (up to 2^29 ids of 32 bits: an Arrow value holds less than 2 GB, else the write fails).

Cases: null text is empty and has the end id alone; a null doc_id sorts first; documents of equal doc_id
stand next to each other, by a hash of their texts; an empty table gives an empty dataset; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Saved, small, text_of
from weftline.llm.elias_fano import EliasFano
from weftline.llm.elias_fano import encode as elias_fano
from weftline.llm.tokenizer import spaced_encoder, vocabulary_size

SEGMENT_IDS = 1 << 20
SEGMENT = "part int, seq int, n_docs long, n_ids long, id_bytes int, doc_ids array<long>, boundaries binary, ids binary"
READ = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("id_bytes", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("boundaries", pa.binary()), ("ids", pa.binary())])


def _segments(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = spaced_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        narrow = max(vocabulary_size(tokenizer_path), end_id + 1) <= 1 << 16
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[bytes] = []
        ends: list[int] = []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4").astype("<u2" if narrow else "<u4")
            row = {"part": part, "seq": seq, "n_docs": len(docs), "n_ids": len(ids), "id_bytes": ids.itemsize, "doc_ids": docs, "boundaries": elias_fano(np.array(ends)), "ids": ids.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                docs.append(doc_id)
                held.append(ids)
                ends.append((ends[-1] if ends else 0) + len(ids) // 4)
                if ends[-1] >= SEGMENT_IDS:
                    yield flush()
                    docs, held, ends, seq = [], [], [], seq + 1
        if docs:
            yield flush()

    return run


def write_token_files(documents: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None):
    """Encodes ``documents`` (doc_id, text) and writes the dataset to ``path``, or to the shared folder.
    Returns a handle with read()."""
    rows = documents.select("doc_id", text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    # the hash deals rows of one doc_id (or without one) over several ranges
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    segments = rows.mapInArrow(_segments(tokenizer_path, end_id), SEGMENT)
    if path is None:
        return Saved(segments, "token-files")
    segments.write.option("compression", "zstd").parquet(path)
    return segments.sparkSession.read.schema(SEGMENT).parquet(path)


def read_token_files(segments: DataFrame) -> DataFrame:
    """One row per document of a dataset: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):  # a row is a segment
            for row in batch.to_pylist():
                bounds = EliasFano(row["boundaries"])
                ends = np.fromiter(map(bounds.select, range(len(bounds))), np.int64, len(bounds))
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                ids = np.frombuffer(row["ids"], "<u2" if row["id_bytes"] == 2 else "<u4").astype("<u4")
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())], names=["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    docs = segments.select("part", "seq", "id_bytes", "doc_ids", "boundaries", "ids").mapInArrow(run, READ)
    sizes = segments.select("part", "seq", "n_ids")
    # ids before a segment: those of earlier parts (as many rows as write tasks) and of earlier segments in its part
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part").select("part", "seq", (F.col("inside") + F.col("part_start")).alias("segment_start"))
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("local_start") + F.col("segment_start")).alias("start"), "n_tokens", "ids_crc32")
