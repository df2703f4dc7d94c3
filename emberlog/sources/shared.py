"""Cuts in a plan, and an even deal of rows.

A cut writes a DataFrame to the folder that the cluster names in ``spark.checkpoint.dir`` and reads it back, so that
what follows is planned anew, nothing before it is computed twice, and a lost executor undoes nothing.  Only where that
setting is missing on one machine (tests) a temporary folder is made and set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="emberlog-")
        atexit.register(shutil.rmtree, folder, True)
        named = "file://" + folder
        spark.conf.set(_KEY, named)
    return named.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer: a table of few row groups is a few tasks
    otherwise, however much work a row is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
