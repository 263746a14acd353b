"""Cutting lineage in storage that outlives executors.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a
local session without that setting (tests, benchmark) gets a folder of its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    in_use = sc.getCheckpointDir()
    if in_use:
        return in_use
    if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="tallybook-")
    sc.setCheckpointDir(own)
    return own


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/tallybook/{label}-{uuid.uuid4().hex}"
