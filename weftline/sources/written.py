"""Tables written to the session's shared folder, which cut both lineage and plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once and read from there. A lost executor costs a reread of files, not a rerun."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, folder: str) -> tuple:
    """Path, length and time of change of what lies in a folder, by Spark's own file system; a folder that can't be listed has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


class Latest:
    """What was built last over a folder, as long as neither session nor files have changed; one is held at a time. Its written files stay for frames that still read them."""

    def __init__(self, build: Callable):
        self.build, self.key, self.value = build, None, None

    def __call__(self, spark: SparkSession, folder: str):
        key = spark.sparkContext.applicationId, folder, state_of(spark, folder)
        if key != self.key:
            self.value = None
            self.key, self.value = key, self.build(spark, folder)
        return self.value
