"""Intermediate tables in the folder that all executors share.

Loops cut their lineage here: a table is written as Parquet below ``spark.checkpoint.dir`` and
read back, so an executor that dies costs one task's work and the plan of the next round stays
short. A loop drops the tables that no later round reads; what a returned frame still reads stays
until the session ends, when the tables of all jobs are deleted.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode, where that may be unset, a new folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one job: ``save`` writes and rereads, ``drop`` deletes; with ``tidy`` shuffle files go as soon as their table stands."""

    def __init__(self, spark: SparkSession, job: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        self.n = 0
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)  # only what exists can be marked for deletion
        files.deleteOnExit(path)

    def save(self, df: DataFrame, name: str = "t", **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}_{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true" if self.tidy else before)
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # keeps the frame's table findable for drop()
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the table behind a frame returned by ``save``."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
