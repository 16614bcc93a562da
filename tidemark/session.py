"""What jobs need from their session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: ``spark.checkpoint.dir``, or where a local session has none
    (as in tests) one of this machine. On a cluster the setting is needed."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Parquet tables in the folder all executors share, which cut lineage and are dropped when they are of no more use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def store(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.folder}/{name}")

    def clear(self) -> None:
        delete(self.spark, self.folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` stored in the folder all executors share, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
