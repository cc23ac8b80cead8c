"""Whole-number helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(x: Column, n: int) -> Column:
    """``x div n`` rounded down, exact for every BIGINT."""
    return F.call_function("div", x - F.pmod(x, F.lit(n).cast("bigint")), F.lit(n).cast("bigint"))
