"""Byte-level BPE by ranks: a segment tree over byte positions keeps the leftmost pair of least rank.

A leaf is a byte position; its value is the rank of the pair that its token makes with the next live token, then the
position. An inner node holds the least value below it, so the root names the leftmost pair of least rank. A merge
removes one live neighbour and changes at most three leaves, each a logarithmic update, so an n-byte match costs
O(n log n).
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import small, text_of
from weftline.llm.pieces import CACHED_LENGTH, SpacedEncoder

NO_PAIR = 1 << 62
#: Matches whose ids a worker remembers.
MATCHES = 1 << 18
ENCODED = "doc_id long, ids array<int>, decoded binary"


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pattern match."""
    n = len(piece)
    if n == 1 or piece in ranks:
        return [ranks[piece]]
    get = ranks.get
    shift = n.bit_length()
    width, position = 1 << (n - 2).bit_length(), (1 << shift) - 1
    tree = [NO_PAIR] * (2 * width)
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[width + i] = rank << shift | i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, rank: int | None) -> None:
        value = NO_PAIR if rank is None else rank << shift | i
        i += width
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if tree[i] == value:
                return
            tree[i] = value

    end = list(range(1, n + 1))  # of the token that starts here: the next live position
    before = list(range(-1, n))
    while (least := tree[1]) != NO_PAIR:
        i = least & position
        gone = end[i]
        end[i] = stop = end[gone]
        if gone < n - 1:
            put(gone, None)
        if stop < n:
            before[stop] = i
            put(i, get(piece[i : end[stop]]))
        else:
            put(i, None)
        if (j := before[i]) >= 0:
            put(j, get(piece[j:stop]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@functools.cache
def encoder(path: str, pattern: str) -> SpacedEncoder:
    """text -> little-endian unsigned 32-bit ids; each match of the pattern is merged separately."""
    import regex

    find, ranks = regex.compile(pattern).findall, ranks_of(path)
    known = functools.lru_cache(MATCHES)(lambda match: array("I", merge(match.encode(), ranks)).tobytes())

    def encode(piece: str) -> bytes:
        return b"".join([known(x) if len(x) <= CACHED_LENGTH else known.__wrapped__(x) for x in find(piece)])

    return SpacedEncoder(encode)


@functools.cache
def vocabulary(path: str) -> list[bytes]:
    """id -> bytes."""
    ranks = ranks_of(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded: the ids of every whole text, and the bytes that these ids decode to.

    Null and empty texts have no ids; lone surrogates can't occur in Spark's UTF-8; repeated rows are encoded each;
    an empty table gives no rows; other columns are ignored. No shuffle.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode, words = encoder(ranks_path, pattern), vocabulary(ranks_path)
        for batch in small(batches):
            rows = [np.frombuffer(encode(text), "<u4") for text in batch.column(1).to_pylist()]
            decoded = [b"".join(map(words.__getitem__, ids.tolist())) for ids in rows]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(ids) for ids in rows], out=offsets[1:])
            flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.binary())], schema=kinds)

    return documents.select("doc_id", text_of().alias("text")).mapInArrow(run, ENCODED)
