"""What the corpus operators share: reading tables, saved intermediate tables, batch sizes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.written import shared_folder as shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Saved:
    """A table in the shared folder, which cuts the lineage: a lost executor costs a reread of files, not a rerun."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files, once nothing reads them any more."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(conf).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    return Saved(df, name).read()


def small(batches: Iterator, rows: int = 512) -> Iterator:
    """Slices of few rows, as texts may be very long; Spark itself holds a batch to 64 MB. No session setting changes."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def text_of(column: str = "text"):
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))
