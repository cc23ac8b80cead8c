"""Intermediate tables of jobs with many steps."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from stepfold.plans.lineage import cut


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, after which Spark may drop the shuffle files of steps that nothing refers to.

    It drops them when their objects are collected; a driver with little to do would not collect them until the job is over.
    """
    out = cut(df)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out
