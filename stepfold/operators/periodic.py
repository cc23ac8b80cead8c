"""Recognise clock-like signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.functions.rounding import floor_div
from stepfold.operators.blocks import SPANS, next_, prev, scan, spread_join
from stepfold.schema import KNOWN, SIGNAL_KEY

# Fixed value: fewest toggles of a clock.
MIN_TOGGLES = 6


def detect_periodic(transitions: DataFrame, signals: DataFrame, block: int, min_toggles: int = MIN_TOGGLES,
                    tolerance: int = 0, spans: Sequence[int] = SPANS) -> DataFrame:
    """Clocks per (signal, block of ``block`` cycles).

    A one-bit signal is a clock in a block when it has at least ``min_toggles`` toggles there, is 0
    or 1 throughout, alternates from the value it entered the block with, and every gap from the
    third toggle on is within ``tolerance`` of the second gap. The result gives the entering value,
    the offset of the first toggle, the half period and the number of toggles.

    Everything is one scan for the neighbours and one hash aggregate: the second gap is the one
    whose row has a predecessor in the block that itself has none.
    """
    bits = signals.where(F.col("kind") == "bit").select(*SIGNAL_KEY)
    # A zero at cycle 0 is the implicit start, not a toggle.
    toggles = transitions.where(~((F.col("cycle") == 0) & (F.col("raw_bits") == 0) & (F.col("state") == KNOWN)))
    rows = spread_join(toggles, bits, SIGNAL_KEY, "cycle", "left_semi").withColumn("block", floor_div(F.col("cycle"), block))
    near = scan(rows, SIGNAL_KEY, "cycle",
                [prev("cycle", "prev_cycle"), prev("raw_bits", "prev_bits"), prev("state", "prev_state"),
                 next_("cycle", "next_cycle")], spans)
    start = F.col("block") * block
    first = F.col("prev_cycle").isNull() | (F.col("prev_cycle") < start)
    gap = F.when(~first, F.col("cycle") - F.col("prev_cycle"))
    ahead_gap = F.when(first & (F.col("next_cycle") < start + block), F.col("next_cycle") - F.col("cycle"))
    good = ((F.col("state") == KNOWN) & (F.coalesce("prev_state", F.lit(KNOWN)) == KNOWN)
            & (F.coalesce("prev_bits", F.lit(0)).bitwiseAND(F.lit(1).cast("bigint"))
               != F.col("raw_bits").bitwiseAND(F.lit(1).cast("bigint"))))
    per = near.select(*SIGNAL_KEY, "block", "cycle", first.alias("first"), gap.alias("gap"), ahead_gap.alias("second"),
                      good.alias("good"), F.coalesce("prev_bits", F.lit(0)).alias("entering"))
    out = per.groupBy(*SIGNAL_KEY, "block").agg(
        F.count("*").alias("toggles"), F.bool_and("good").alias("good"),
        F.max("second").alias("half_period"), F.min("gap").alias("least"), F.max("gap").alias("most"),
        F.min("cycle").alias("first_cycle"), F.max(F.when(F.col("first"), F.col("entering"))).alias("initial_bits"))
    near_second = (F.col("most") - F.col("half_period") <= tolerance) & (F.col("half_period") - F.col("least") <= tolerance)
    return out.where((F.col("toggles") >= min_toggles) & F.col("good") & near_second).select(
        *SIGNAL_KEY, "block", "initial_bits", (F.col("first_cycle") - start).alias("first_offset"), "half_period", "toggles")


def detect_stride(transitions: DataFrame, min_events: int = MIN_TOGGLES, spans: Sequence[int] = SPANS) -> DataFrame:
    """Signals of any type whose events are all the same number of cycles apart."""
    gaps = scan(transitions.select(*SIGNAL_KEY, "cycle"), SIGNAL_KEY, "cycle", [prev("cycle", "before")], spans)
    gap = F.col("cycle") - F.col("before")
    per = gaps.groupBy(*SIGNAL_KEY).agg(F.count("*").alias("events"), F.min("cycle").alias("first_cycle"),
                                        F.min(gap).alias("stride"), F.max(gap).alias("most"))
    return per.where((F.col("events") >= min_events) & (F.col("stride") == F.col("most"))).drop("most")
