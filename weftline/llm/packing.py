"""Order-preserving packing of documents into token windows by dynamic programming.

The stream of documents, in table order, may be cut at document ends, sentence ends and, inside a sentence
longer than a stride, at every stride. best[j] = min over cuts i at most a window before j of
best[i] + padding of (i, j) + penalty of cutting at j. The padding is window - (pos j - pos i), so
best[i] + pos i is minimised over a sliding range, which a monotone queue answers in constant amortised time.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftline.llm.common import small, text_of
from weftline.llm.pieces import WORD_ENTRIES
from weftline.llm.tokenizer import sentence_end_ids, word_encoder

WINDOW = 4096
#: What a cut costs, in padding tokens: at a document's end, at a sentence's end, inside a sentence.
PENALTIES = (0, 8, 64)
#: Inside a sentence a cut may fall at multiples of this many tokens of its document.
STRIDE = 64
#: Tokens that are planned together; the last window of a block opens the next one.
BLOCK = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def plan(positions: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Positions where windows end. positions: ascending cuts after 0, gaps of at most a window; the last is the end."""
    where, cost = [0, *positions.tolist()], [0, *penalties.tolist()]
    n = len(where)
    best, parent = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best + position, cut), ascending
    for j in range(1, n):
        at = where[j]
        while where[queue[0][1]] < at - window:
            queue.popleft()
        least, parent[j] = queue[0]
        best[j] = total = least + window - at + cost[j]
        total += at
        while queue and queue[-1][0] > total:
            queue.pop()
        queue.append((total, j))
    out, j = [], n - 1
    while j:
        out.append(where[j])
        j = parent[j]
    return out[::-1]


def cuts_of(ids: np.ndarray, ends: np.ndarray, stride: int, penalties: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of one document, after its first token, and what they cost."""
    n = len(ids)
    cost = np.full(n + 1, -1, np.int64)
    cost[stride:n:stride] = penalties[2]
    cost[1:][ends[ids]] = penalties[1]
    cost[n] = penalties[0]
    where = np.flatnonzero(cost >= 0)
    return where, cost[where]


def pack_documents(documents: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, penalties: tuple[int, int, int] = PENALTIES, stride: int = STRIDE, block: int = BLOCK, entries: int = WORD_ENTRIES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents keep the table's order within each input partition, which is packed on its own: one window at its
    end may be short. sequence_id is the partition times 2^32 plus the window's number. Null and empty texts are the
    end id alone; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    entries: of a worker's cache of words; with more it encodes fewer words again, and needs more memory.
    """
    assert 0 < stride <= window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # a worker may have served other stages before
        encode, end = word_encoder(tokenizer_path, entries), np.array([end_id], "<u4").tobytes()
        ends = sentence_end_ids(tokenizer_path)
        if end_id >= len(ends):
            ends = np.pad(ends, (0, end_id + 1 - len(ends)))
        sequence = TaskContext.get().partitionId() << 32
        held: list[list] = []  # [doc_id, ids, first token not yet packed]
        size = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal sequence, held, size
            where, cost, at, spans = [], [], 0, []
            for doc_id, ids, first in held:
                w, c = cuts_of(ids, ends, stride, penalties)
                w, c = w[w > first], c[len(w) - np.count_nonzero(w > first) :]
                where.append(w + (at - first))
                cost.append(c)
                spans.append((at, at + len(ids) - first))
                at += len(ids) - first
            stops = plan(np.concatenate(where), np.concatenate(cost), window)
            if not last and len(stops) > 1:
                stops.pop()  # the last window may still grow
            rows: list[tuple] = []
            begin, k = 0, 0
            for stop in stops:
                offset = 0
                while begin < stop:
                    (low, high), (doc_id, ids, first) = spans[k], held[k]
                    upto = min(stop, high)
                    start = begin - low + first
                    piece = ids[start : start + upto - begin]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), sequence, offset))
                    offset += len(piece)
                    begin = upto
                    k += begin == high
                sequence += 1
            rest = [[doc_id, ids, max(first, first + begin - low)] for (doc_id, ids, first), (low, high) in zip(held[k:], spans[k:], strict=True)]
            held, size = rest, at - begin
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=_ARROW)

        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encode(text) + end, "<u4")
                held.append([doc_id, ids, 0])
                size += len(ids)
                if size >= block:
                    yield flush(last=False)
        if held:
            yield flush(last=True)

    return documents.select("doc_id", text_of().alias("text")).mapInArrow(run, PIECES)
