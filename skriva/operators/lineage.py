"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Only a local session may be without; it gets a local one."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context._conf.get("spark.checkpoint.dir")
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="skriva-")
        spark.conf.set("spark.checkpoint.dir", where)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder, so that later plans read it and a lost executor costs a read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A scan in as many partitions as the session works on at once, where it has fewer; for rows that are dear to work on."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
