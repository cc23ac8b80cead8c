"""Shared folders: where lineage is cut and where intermediate tables are written.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without
that setting (tests) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from that table.

    Used where a result feeds several branches of a later plan, so that the branches read it
    instead of recomputing it, and in loops. A table is computed once, where a checkpoint computes
    its last stage twice; it outlives executors, and its size is known to the planner, which then
    broadcasts it only if it is small.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
