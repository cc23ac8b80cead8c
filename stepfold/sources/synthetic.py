"""Rows that are generated rather than stored: clocks and a load-test workload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.functions.bits import mask_of
from stepfold.schema import KNOWN, state

# Cycles between updates of the first signals, the burst and the groups of the workload.
PERIODS = {1: 1, 2: 1, 3: 4, 4: 8, 5: 17, 6: 31}
BURST_EVERY, BURST_SIZE = 257, 16
GROUPS = 8


def synthetic_clock(clocks: DataFrame, meta: DataFrame, t0: int | None = None, t1: int | None = None,
                    max_toggles: int | None = None, part: int = 1 << 20) -> DataFrame:
    """Rows of periodic clocks: at each multiple of the period the value flips, starting at cycle 0.

    Rows run to the trace end or ``t1``. A long clock is first cut into parts of ``part`` toggles,
    which are spread over the tasks, so no task or array holds a whole clock.
    """
    joined = clocks.join(meta.select("trace_id", "end"), "trace_id").where("period_ticks > 0")
    last = F.col("end") if t1 is None else F.least("end", F.lit(t1))
    n = F.call_function("div", F.greatest(last, F.lit(-1)), F.col("period_ticks"))
    first = F.lit(0).cast("bigint") if t0 is None else F.call_function(
        "div", F.lit(max(t0, 0)) + F.col("period_ticks") - 1, F.col("period_ticks"))
    if max_toggles is not None:
        n = F.least(n, F.lit(max_toggles - 1))
    spans = joined.select("trace_id", "signal_id", "initial_value", "period_ticks", first.alias("k0"), n.alias("k1"),
                          last.alias("last")).where("k1 >= k0 AND last >= 0")
    parts = spans.withColumn("p", F.explode(F.sequence(F.call_function("div", F.col("k0"), F.lit(part)),
                                                       F.call_function("div", F.col("k1"), F.lit(part)))))
    parts = parts.repartition("trace_id", "signal_id", "p")
    lo, hi = F.greatest("k0", F.col("p") * part), F.least("k1", F.col("p") * part + (part - 1))
    ticks = parts.withColumn("k", F.explode(F.sequence(lo, hi)))
    bit = F.col("initial_value").cast("bigint").bitwiseXOR(F.col("k").bitwiseAND(F.lit(1).cast("bigint")))
    return ticks.select("trace_id", "signal_id", (F.col("k") * F.col("period_ticks")).alias("cycle"),
                        bit.alias("raw_bits"), state(KNOWN).alias("state"))


def synthetic_signals(spark: SparkSession, signals: int, trace_id: str = "synthetic") -> DataFrame:
    """Layout of the workload: types by the last digit of the id, eight groups under one root."""
    i = F.col("signal_id")
    digit = i % 10
    value_type = (F.when((digit == 0) | (i == 2), "Bool").when(digit <= 4, "U32").otherwise("U64"))
    width = F.when(F.col("value_type") == "Bool", 1).when(F.col("value_type") == "U32", 32).otherwise(64)
    name = F.format_string("metric_%04d", i)
    return (spark.range(1, signals + 1).select(F.lit(trace_id).alias("trace_id"), F.col("id").alias("signal_id"))
            .withColumn("storage_id", i).withColumn("node_id", i + (GROUPS + 1)).withColumn("name", name)
            .withColumn("path", F.concat(F.lit("top.group_"), (i % GROUPS).cast("string"), F.lit("."), name))
            .withColumn("value_type", value_type).withColumn("width", width.cast("int"))
            .withColumn("kind", F.when(F.col("width") == 1, "bit").otherwise("bus"))
            .withColumn("bit_offset", F.lit(0)).withColumn("radix", F.lit("auto")).withColumn("storage_only", F.lit(False))
            .withColumn("since_cycle", F.lit(0).cast("bigint")).withColumn("initial_bits", F.lit(0).cast("bigint")))


def workload(cycles: DataFrame, signals: int, updates_per_cycle: int = 1, trace_id: str = "synthetic") -> DataFrame:
    """Samples of a deterministic load at the given cycles, one row of ``cycles`` (cycle) each.

    Signals 1 to 6 are updated at fixed periods, one or more ids from 7 on in rotation, and every
    257 cycles a burst touches 16 consecutive ids. Values come from a hash of (signal, cycle). Each
    cycle is worked out on its own, so there is no shuffle.
    """
    cycle = F.col("cycle")
    rotating = max(0, signals - 6)
    ids = [F.when(cycle % period == 0, F.lit(i).cast("bigint")) for i, period in PERIODS.items() if i <= signals]
    ids = [F.array_compact(F.array(*ids))]
    if rotating:
        turn = F.transform(F.sequence(F.lit(0), F.lit(updates_per_cycle - 1)),
                           lambda k: (cycle * updates_per_cycle + k) % rotating + 7)
        burst = F.transform(F.sequence(F.lit(0), F.lit(BURST_SIZE - 1)), lambda k: (cycle + k) % rotating + 7)
        ids += [turn, F.when(cycle % BURST_EVERY == 0, burst).otherwise(F.array().cast("array<bigint>"))]
    rows = cycles.select("cycle", F.posexplode(F.array_distinct(F.concat(*ids))).alias("seq", "storage_id"))
    digit = F.col("storage_id") % 10
    width = (F.when((digit == 0) | (F.col("storage_id") == 2), 1).when(digit <= 4, 32).otherwise(64))
    return rows.select(F.lit(trace_id).alias("trace_id"), "storage_id", "cycle", F.col("seq").cast("bigint").alias("seq"),
                       F.xxhash64("storage_id", "cycle").bitwiseAND(mask_of(width)).alias("raw_bits"),
                       state(KNOWN).alias("state"))


def synthetic_trace(spark: SparkSession, cycles: int, signals: int, updates_per_cycle: int = 1,
                    trace_id: str = "synthetic") -> DataFrame:
    """The load over cycles 0 to ``cycles - 1``."""
    return workload(spark.range(cycles).select(F.col("id").alias("cycle")), signals, updates_per_cycle, trace_id)
