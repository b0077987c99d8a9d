"""Substring search by trigram postings: a stored table of (gram, id) narrows the rows down, and the text itself is then looked for in them.

Postings lie in folders by a hash of the gram, sorted by gram within a file; so a search opens the folders of its grams alone, and of their files, by the
grams' least and greatest values, few row groups. Every row that holds the text in one column has all of its grams, so nothing is lost; rows that have the grams elsewhere are sorted
out by the check. Texts of fewer than three characters have no gram and are looked for in all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a postings table, and the parts of a folder, so that a gram that most rows have is several files.
FOLDERS, PARTS, LENGTH = 64, 4, 3


def grams_of(text: Column) -> Column:
    """Distinct trigrams of a text in lower case; a null or short one has none."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    starts = F.when(F.length(lowered) >= LENGTH, F.sequence(F.lit(1), F.length(lowered) - (LENGTH - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(lowered, i, F.lit(LENGTH))))


def folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def write_postings(rows: DataFrame, id_column: str, columns: list[str], path: str) -> None:
    """The trigrams of all ``columns`` of each row; ids are single."""
    held = F.array_distinct(F.flatten(F.array(*[grams_of(F.col(c).cast("string")) for c in columns])))
    postings = rows.select(F.col(id_column).alias("id"), F.explode(held).alias("gram")).withColumn("folder", folder_of(F.col("gram")))
    dealt = postings.repartition("folder", F.pmod(F.xxhash64("id"), F.lit(PARTS))).sortWithinPartitions("folder", "gram", "id")
    dealt.write.partitionBy("folder").parquet(path)


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """Ids whose rows have every trigram of the text, or None for a text that is too short to have one."""
    asked = [r.gram for r in spark.range(1).select(F.explode(grams_of(F.lit(text.strip()))).alias("gram")).collect()]
    if not asked:
        return None
    folders = [r.f for r in spark.createDataFrame([(g,) for g in asked], "gram string").select(folder_of(F.col("gram")).alias("f")).distinct().collect()]
    near = spark.read.parquet(path).where(F.col("folder").isin(folders) & F.col("gram").isin(asked))
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(asked)).select("id")


def narrowed(rows: DataFrame, id_column: str, path: str, text: str) -> DataFrame:
    """The rows that may hold the text."""
    found = candidates(rows.sparkSession, path, text)
    return rows if found is None else rows.join(found.withColumnRenamed("id", id_column), id_column, "left_semi")
