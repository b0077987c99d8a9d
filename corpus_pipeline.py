"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, packing.

Each stage works on all rows that the one before it kept, is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import line_dedup, packing, quality, simhash
from weftline.llm.common import shared_dir, table

#: Near duplicates in the pipeline are compared by shingles of so many words.
SHINGLE = 5
#: ... and link from this Jaccard similarity on, besides fingerprints at two bits.
SIMILARITY = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's perplexity band go; null texts are empty and go, equal rows share one verdict."""
    return quality.judge(docs).where("kept").select("row.*")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document of which nothing is left stays, with an empty text. Null texts stay null; equal rows get one result."""
    rows = line_dedup.dedup_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id (null: last), then by a hash of its text.
    Rows equal in both are one document. Null texts count as empty."""
    return simhash.one_of_each(docs, shingle=SHINGLE, similarity=SIMILARITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_deduplication), ("near_dedup", near_deduplication), ("packing", pack)]

#: The stages count n-grams, hash and plan cuts in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
