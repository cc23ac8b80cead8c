"""Traces on disk as tiles of time block x signal chunk, and loading parts of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.functions.rounding import floor_div
from stepfold.operators.blocks import SPANS, scan, prev
from stepfold.schema import SIGNAL_KEY, TILE_CYCLES, TILE_SIGNALS

#: For writes that count only once they are logged: each task moves its files into place, instead of the driver all of them.
TASKS_COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def time_block(cycle: Column, span: int = TILE_CYCLES) -> Column:
    return floor_div(cycle, span)


def signal_chunk(storage_id: Column, chunk: int = TILE_SIGNALS) -> Column:
    return floor_div(storage_id - 1, chunk)


def with_tiles(transitions: DataFrame, signal: str = "signal_id", span: int = TILE_CYCLES,
               chunk: int = TILE_SIGNALS) -> DataFrame:
    return transitions.withColumns({"time_block": time_block(F.col("cycle"), span),
                                    "signal_chunk": signal_chunk(F.col(signal), chunk)})


def write_tiled(transitions: DataFrame, path: str, signal: str = "signal_id", span: int = TILE_CYCLES,
                chunk: int = TILE_SIGNALS, files_per_tile: int = 1, mode: str = "overwrite") -> None:
    """Write tiles as Parquet partitions; a tile without events has no partition.

    Rows of a tile are sorted by signal and cycle, so row groups prune within it. A tile is bounded
    by ``span * chunk`` events; ``files_per_tile`` splits a dense one over several tasks by signal.
    """
    tiled = with_tiles(transitions, signal, span, chunk)
    part = F.pmod(F.col(signal), F.lit(files_per_tile))
    (tiled.repartition("time_block", "signal_chunk", part).sortWithinPartitions("time_block", "signal_chunk", signal, "cycle")
     .write.mode(mode).partitionBy("time_block", "signal_chunk").option("compression", "zstd").parquet(path))


def read_tiled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def tile_index(transitions: DataFrame, signals: DataFrame, signal: str = "signal_id", span: int = TILE_CYCLES,
               chunk: int = TILE_SIGNALS) -> DataFrame:
    """One row per non-empty tile: its range, its signal slots, active signals and records.

    The last block of a trace ends one cycle after its last event, others at their boundary. Active
    signals are counted in two steps, so no distinct set is held per tile.
    """
    tiled = with_tiles(transitions, signal, span, chunk)
    key = ["trace_id", "time_block", "signal_chunk"]
    per_signal = tiled.groupBy(*key, signal).agg(F.count("*").alias("n"), F.max("cycle").alias("last"))
    tiles = per_signal.groupBy(*key).agg(F.count("*").alias("active_signals"), F.sum("n").cast("bigint").alias("records"),
                                         F.max("last").alias("last"))
    top = signals.groupBy("trace_id").agg(F.max(signal).alias("max_id"))
    last = tiles.groupBy("trace_id").agg(F.max("last").alias("last_cycle"))
    joined = tiles.join(top, "trace_id").join(last, "trace_id")
    first_id = F.col("signal_chunk") * chunk + 1
    is_last = F.col("time_block") == time_block(F.col("last_cycle"), span)
    return joined.select(
        *key, (F.col("time_block") * span).alias("start_cycle"),
        F.when(is_last, F.col("last_cycle") + 1).otherwise((F.col("time_block") + 1) * span).alias("end_cycle"),
        first_id.alias("first_signal_id"),
        F.least(F.lit(chunk), F.col("max_id") - first_id + 1).cast("bigint").alias("signal_count"),
        "active_signals", "records")


def tile_times(transitions: DataFrame, signal: str = "signal_id", span: int = TILE_CYCLES,
               chunk: int = TILE_SIGNALS) -> DataFrame:
    """Distinct change times per tile."""
    key = ["trace_id", "time_block", "signal_chunk"]
    distinct = with_tiles(transitions, signal, span, chunk).select(*key, "cycle").distinct()
    return distinct.groupBy(*key).agg(F.count("*").alias("change_times"))


def load_signals(tiled: DataFrame, signal_ids: Sequence[int] | DataFrame | None = None, t0: int | None = None,
                 t1: int | None = None, signal: str = "signal_id", span: int = TILE_CYCLES, chunk: int = TILE_SIGNALS,
                 fallback: bool = False) -> DataFrame:
    """Selected signals in the inclusive window ``[t0, t1]``; ``t1 < t0`` means no window.

    The tile columns cannot be derived from cycle and signal by the optimizer, so the predicates on
    them are added here: partitions are pruned first, row groups by cycle and signal after. Ids may
    be a list, for a handful of signals, or a table (trace_id, signal), joined with dynamic pruning.
    ``fallback`` drops the window when it is empty and no ids were given.
    """
    rows = tiled
    if isinstance(signal_ids, DataFrame):
        wanted = signal_ids.select("trace_id", signal, signal_chunk(F.col(signal), chunk).alias("signal_chunk"))
        rows = rows.join(wanted, ["trace_id", signal, "signal_chunk"], "left_semi")
    elif signal_ids is not None:
        ids = sorted(set(signal_ids))
        chunks = sorted({(i - 1) // chunk for i in ids})
        rows = rows.where(F.col("signal_chunk").isin(chunks) & F.col(signal).isin(ids))
    windowed = t0 is not None and t1 is not None and t1 >= t0
    if not windowed:
        return rows
    inside = rows.where(F.col("time_block").between(t0 // span, t1 // span) & F.col("cycle").between(t0, t1))
    if fallback and signal_ids is None and inside.limit(1).isEmpty():
        return rows
    return inside


def load_window_carry_in(tiled: DataFrame, signal_ids: Sequence[int] | DataFrame | None, t0: int, t1: int,
                         snapshots: DataFrame | None = None, signal: str = "signal_id", span: int = TILE_CYCLES,
                         chunk: int = TILE_SIGNALS) -> DataFrame:
    """As ``load_signals`` for ``[t0, t1]``, with each signal's value at ``t0`` as a row at ``t0``.

    The value at ``t0`` is the last event at or before it, not an implied zero. With ``snapshots``
    (see ``block_snapshots``) only the block of ``t0`` is read for it, and the snapshots before.
    """
    columns = ["trace_id", signal, "cycle", "raw_bits", "state"]
    earlier = load_signals(tiled, signal_ids, signal=signal, span=span, chunk=chunk).where(
        (F.col("time_block") <= t0 // span) & (F.col("cycle") <= t0))
    if snapshots is not None:
        own_block = earlier.where(F.col("time_block") == t0 // span)
        kept = snapshots.where(F.col("time_block") <= t0 // span)
        if signal_ids is not None:
            # Snapshots carry the value a block was entered with and the value it was left with.
            kept = (kept.join(signal_ids.select("trace_id", signal), ["trace_id", signal], "left_semi")
                    if isinstance(signal_ids, DataFrame) else kept.where(F.col(signal).isin(list(signal_ids))))
        ends = kept.where(F.col("time_block") < t0 // span).select(
            "trace_id", signal, F.col("last_cycle").alias("cycle"), F.col("last_bits").alias("raw_bits"),
            F.col("last_state").alias("state"))
        earlier = own_block.select(*columns).unionByName(ends)
    carried = earlier.groupBy("trace_id", signal).agg(
        F.max_by("raw_bits", "cycle").alias("raw_bits"), F.max_by("state", "cycle").alias("state"))
    carried = carried.withColumn("cycle", F.lit(t0).cast("bigint"))
    later = load_signals(tiled, signal_ids, t0 + 1, t1, signal, span, chunk) if t1 > t0 else None
    out = carried.select(*columns)
    return out if later is None else out.unionByName(later.select(*columns))


def signal_catalogue(signals: DataFrame, transitions: DataFrame) -> DataFrame:
    """All visible signals with the number of their events; constant ones are listed too."""
    counts = transitions.groupBy(*SIGNAL_KEY).agg(F.count("*").alias("events"))
    visible = signals.where(~F.coalesce("storage_only", F.lit(False)))
    return visible.join(counts, SIGNAL_KEY, "left").withColumn("events", F.coalesce("events", F.lit(0).cast("bigint")))


def block_snapshots(transitions: DataFrame, span: int = TILE_CYCLES, signal: str = "signal_id",
                    spans: Sequence[int] = SPANS) -> DataFrame:
    """Per signal and time block with events: the value it is entered with and the value it is left with.

    The entering value is null for a signal's first block. Blocks are aggregated with a map-side
    half; only their edges are scanned.
    """
    edges = transitions.groupBy("trace_id", signal, time_block(F.col("cycle"), span).alias("time_block")).agg(
        F.max("cycle").alias("last_cycle"), F.max_by("raw_bits", "cycle").alias("last_bits"),
        F.max_by("state", "cycle").alias("last_state"))
    return scan(edges, ["trace_id", signal], "time_block",
                [prev("last_bits", "entry_bits"), prev("last_state", "entry_state")], spans[1:])
