"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of signs. An n-gram's vector binds those of its three letters: the first is rotated by two places,
the second by one, and the three are multiplied, so that the order of letters counts. A text's vector bundles, that is adds, the vectors
of all its n-grams; a language's prototype bundles those of all its training texts. A text gets the language of the
prototype with the greatest cosine.

As bundling is a sum, a task counts the n-grams of a language first and binds each distinct one once; tasks send one integer
vector a language, and Spark adds them place by place. Sums are of integers, so the result doesn't depend on the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Saved, small

#: Places of a vector; n-grams bound at once; letters and n-grams that a task holds before it starts anew; languages that are compared in one pass.
DIMENSIONS, SLICE, LETTERS, GRAMS, LANGUAGES = 512, 2048, 16_384, 1 << 20, 2048
UNKNOWN = "und"


class Profiles:
    """Vectors of letters, n-grams and texts. Letters are numbered as they come, which no result depends on."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self._clear()

    def _clear(self) -> None:
        self.number = np.zeros(0x110000, np.int32)
        self.known = [0]
        self.table = np.zeros((0, self.dimensions), np.int8)

    def letter(self, point: int) -> np.ndarray:
        """Signs that depend on the code point alone; 0 is the border of a word."""
        return np.random.default_rng([13, point]).integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1

    def grams(self, text: str) -> np.ndarray:
        """Code points of each run of three symbols, (n, 3): letters, and one border before, between and after words."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.where(self.is_letter[points], points, 0).astype(np.int64)
        if not letters.any():
            return np.zeros((0, 3), np.int64)
        line = np.concatenate(([0], letters, [0]))
        line = line[(line != 0) | np.concatenate(([True], line[:-1] != 0))]
        return np.stack((line[:-2], line[1:-1], line[2:]), 1)

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, each as one number, and how often each occurs."""
        g = self.grams(text)
        return np.unique((g[:, 0] << 42) | (g[:, 1] << 21) | g[:, 2], return_counts=True)

    def _rows(self, points: np.ndarray) -> np.ndarray:
        rows = self.number[points]
        new = np.unique(points[(rows == 0) & (points != 0)])
        if len(new) or not len(self.table):
            self.number[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known += new.tolist()
            fresh = self.known[len(self.table) :]
            self.table = np.concatenate((self.table, np.array([self.letter(p) for p in fresh], np.int8).reshape(-1, self.dimensions)))
            self.once, self.twice = np.roll(self.table, 1, 1), np.roll(self.table, 2, 1)
            rows = self.number[points]
        return rows

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors, as whole numbers."""
        total = np.zeros(self.dimensions, np.int64)
        if len(self.known) > LETTERS:
            self._clear()
        for k in range(0, len(codes), SLICE):
            part, n = codes[k : k + SLICE], counts[k : k + SLICE]
            rows = self._rows(np.stack((part >> 42, (part >> 21) & 0x1FFFFF, part & 0x1FFFFF)))
            bound = self.twice[rows[0]] * self.once[rows[1]] * self.table[rows[2]]
            kind = np.float32 if n.sum() < 1 << 24 else np.float64  # either is exact
            total += (n.astype(kind) @ bound.astype(kind)).astype(np.int64)
        return total


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def prototypes(documents: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """lang and vector (array<long>) from every row of ``documents`` (text, lang). Rows without a language or a letter teach nothing."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, counts, held = Profiles(dimensions), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in counts.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                vector = profiles.bundle(codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vector.tolist()], pa.list_(pa.int64()))], names=["lang", "vector"])
            counts.clear()

        for batch in small(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, n = profiles.counted(text)
                if len(codes):
                    counts.setdefault(lang, []).append((codes, n))
                    held += len(codes)
                if held >= GRAMS:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = documents.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string"))
    parts = rows.mapInArrow(learn, "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("place", "x"))
    sums = parts.groupBy("lang", "place").agg(F.sum("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"])
    return sums.groupBy("lang").agg(ordered.alias("vector"))


def compare(documents: DataFrame, known: DataFrame, dimensions: int = DIMENSIONS, languages: int = LANGUAGES) -> DataFrame:
    """``documents`` (text and other columns) with lang_pred and score, the best cosine or 0 if that is less. ``known``: prototypes.

    Prototypes are read in blocks of about ``languages`` of them; texts are compared with one block after the other, the best is kept.
    Of equal cosines the first language in alphabetic order wins.
    """
    known = Saved(known.where(F.exists("vector", lambda x: x != 0)), "prototypes").read()
    blocks = max(1, -(-known.count() // languages))
    others = [c for c in documents.columns if c != "text"]
    now = documents.select(F.struct(*others).alias("row"), "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score"))
    for b in range(blocks):
        block = known.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b).collect()
        block.sort(key=lambda r: r.lang)
        names, matrix = [r.lang for r in block], np.array([r.vector for r in block], np.float64).reshape(-1, dimensions)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = documents.sparkSession.sparkContext.broadcast((names, matrix))

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            profiles = Profiles(dimensions)
            names, matrix = shared.value
            for batch in small(batches):
                langs, scores = batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist()
                for i, text in enumerate(batch.column("text").to_pylist()):
                    codes, n = profiles.counted(text or "")
                    if not len(codes) or not names:
                        continue
                    vector = profiles.bundle(codes, n).astype(np.float64)
                    cosines = np.round(matrix @ vector / max(np.linalg.norm(vector), 1e-300), 12)  # equal prototypes stay equal
                    best = int(cosines.argmax())
                    if langs[i] is None or cosines[best] > scores[i] or (cosines[best] == scores[i] and names[best] < langs[i]):
                        langs[i], scores[i] = names[best], float(cosines[best])
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "text", "lang_pred", "score"])

        now = now.mapInArrow(judge, now.schema)
    kept = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score"))
    return now.select("row.*", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), kept.alias("score"))


def identify(documents: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``documents`` (doc_id, text, lang).

    Learns from the rows whose crc32(doc_id as text) mod 5 is not 0 (a null doc_id counts as empty text, so it is held out). A null text or one
    without letters gets ``und`` and score 0, and so does every text if nothing could be learned. Equal texts get equal
    results, rows of one doc_id are rows of their own, other columns are ignored and an empty table gives no rows.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    known = prototypes(rows.where("NOT held_out"), dimensions)
    return compare(rows.select("doc_id", "held_out", "text"), known, dimensions)
