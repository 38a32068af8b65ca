"""Cutting a frame's lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of the session's spark.checkpoint.dir. Without one, a temporary folder serves a local session; on a cluster that is
    an error, since executors could not read it."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quern-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise df there, so that later steps see the same rows in the same partitions, whichever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
