"""Shared scratch space: where operators cut lineage and keep their files.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where
that is unset (unit tests on one machine) a temporary folder is made and set.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or path without a trailing slash."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set(_KEY, named)
    return named.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: a cut in the lineage
    that a lost executor cannot undo and that no later action computes again.

    release asks the driver to collect its garbage, on which Spark drops the shuffle
    files that nothing can reach any more; large operators do so between their steps.
    """
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if release:
        for _ in range(2):  # Python's objects first, then what they held in the driver's JVM
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """The scratch tables of one operator call: keep writes and rereads one as materialize does, close deletes all but some."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh(self.spark, label)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((path, out))
        return out

    def close(self, *but: DataFrame) -> None:
        """Delete the tables, but for those that a lazy result still reads."""
        for path, out in self.held:
            if not any(out is x for x in but):
                remove(self.spark, path)
        self.held = [x for x in self.held if any(x[1] is y for y in but)]
