"""Consecutive numbers in a global order without one task that sees every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepfold.plans.lineage import cut


def dense_number(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Number the rows 1, 2, … by ``order``, which must be unique.

    The rows are range-sorted and written once; a row's number is its place inside its partition
    plus the sizes of the partitions before. Only that list of sizes, one row per partition, goes
    through a single window.
    """
    placed = cut(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    # The id holds the partition in its upper 31 bits, the row in its lower 33.
    placed = placed.select(*df.columns, F.shiftright("__id", 33).alias("__part"),
                           F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__row"))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return placed.join(offsets, "__part").withColumn(
        out, (F.col("__offset") + F.col("__row") + 1).cast("bigint")).drop("__part", "__row", "__offset")
