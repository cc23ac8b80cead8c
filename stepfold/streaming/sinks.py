"""Streaming sinks: tiles on disk and overview windows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepfold.operators.blocks import spread_join
from stepfold.operators.overview import BASE_CYCLES, LEVEL_RATIO, LEVELS
from stepfold.schema import SIGNAL_KEY, TILE_CYCLES, TILE_SIGNALS, TRANSITIONS
from stepfold.sources.tiles import with_tiles
from stepfold.streaming.ingest import ALL_THERE_IS
from stepfold.streaming.state import SHARED_BITS, OpenWindows, keyed_state


def stream_tiles(changes: DataFrame, path: str, checkpoint: str, signal: str = "signal_id", span: int = TILE_CYCLES,
                 chunk: int = TILE_SIGNALS, trigger: Mapping[str, object] = ALL_THERE_IS) -> StreamingQuery:
    """Append changes to tiles. The sink's commit log makes each batch visible as a whole, once.

    Rows are brought together by tile first, so a batch adds one file per tile it touches and not
    one per task and tile.
    """
    tiled = with_tiles(changes, signal, span, chunk).repartition("time_block", "signal_chunk")
    return (tiled.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .option("compression", "zstd").partitionBy("time_block", "signal_chunk")
            .trigger(**trigger).start())


def closed_tiles(tiled: DataFrame, ended: DataFrame | None = None) -> DataFrame:
    """Rows of blocks that can no longer grow: all but the last block of each trace.

    Traces in ``ended`` (trace_id) will get no more rows, so their last block is closed as well.
    """
    last = tiled.groupBy("trace_id").agg(F.max("time_block").alias("last_block"))
    if ended is not None:
        over = ended.select("trace_id", F.lit(True).alias("over")).distinct()
        last = last.join(over, "trace_id", "left").withColumn(
            "last_block", F.when(F.col("over"), F.col("last_block") + 1).otherwise(F.col("last_block"))).drop("over")
    return spread_join(tiled, last, ["trace_id"], "cycle").where("time_block < last_block").drop("last_block")


def end_marks(signals: DataFrame, ends: DataFrame) -> DataFrame:
    """A row without state for each of ``signals`` at its trace's ``end``, which closes all its windows: what a writer sends last."""
    return spread_join(signals.select(*SIGNAL_KEY).withColumn("cycle", F.lit(0).cast("bigint")).distinct(), ends.select("trace_id", "end"), ["trace_id"], "signal_id").select(
        *SIGNAL_KEY, F.col("end").cast("bigint").alias("cycle"), F.lit(None).cast("bigint").alias("raw_bits"), F.lit(None).cast("tinyint").alias("state"))


def lod_windows(changes: DataFrame, levels: int = LEVELS, base: int = BASE_CYCLES, ratio: int = LEVEL_RATIO) -> DataFrame:
    """Last change of each closed window of ``base * ratio^k`` cycles, all levels in one pass, and refused rows (level -1) with their reason.

    A signal's window of some level is closed by the signal's next change outside it or by its end mark, not by other signals, so
    no signal has to keep up with the rest. What ``close_windows`` refuses stays in the result: nothing is lost.
    """
    buckets = [base * ratio ** k for k in range(levels)]
    named, zero = TRANSITIONS.names, F.lit(0)
    needed = [F.col(c).isNull() if c != "raw_bits" else F.col(c).isNull() & F.col("state").isNotNull() for c in named[:4]]
    ends = F.col("state").isNull()
    missing = reduce(Column.__add__, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(named)])
    rows = changes.withColumns({"missing": missing, "ends": ends, "reason": F.when(reduce(Column.__or__, needed), F.lit("incomplete"))})
    rows = rows.select(*[F.coalesce(f.name, F.lit("").cast("string") if f.name == "trace_id" else zero.cast(f.dataType)).alias(f.name) for f in TRANSITIONS],
                       "missing", "ends", "reason")
    out = rows.withColumn("shared", F.shiftright("signal_id", SHARED_BITS)).groupBy("trace_id", "shared").transformWithStateInPandas(
        OpenWindows(buckets), "trace_id string, signal_id long, level int, window_start long, cycle long, raw_bits long, state byte, reason string, missing int",
        outputMode="Append", timeMode="None")
    bucket = F.when(F.col("level") >= 0, F.element_at(F.array(*[F.lit(b).cast("bigint") for b in buckets]), F.greatest("level", zero) + 1))
    restored = {c: F.when(F.col("missing").bitwiseAND(1 << i) == 0, F.col(c)) for i, c in enumerate(named)}
    return out.withColumns(restored | {"bucket": bucket}).select(*SIGNAL_KEY, "level", "bucket", "window_start", "cycle", "raw_bits", "state", "reason")


def stream_lod(changes: DataFrame, path: str, checkpoint: str, levels: int = LEVELS, base: int = BASE_CYCLES, ratio: int = LEVEL_RATIO,
               trigger: Mapping[str, object] = ALL_THERE_IS) -> StreamingQuery:
    """Write what ``lod_windows`` finds as Parquet by level; ``read_lod`` and ``read_late`` read it."""
    with keyed_state(changes.sparkSession):
        return (lod_windows(changes, levels, base, ratio).writeStream.outputMode("append").format("parquet").option("path", path)
                .option("checkpointLocation", checkpoint).partitionBy("level").trigger(**trigger).start())


def read_lod(spark: SparkSession, path: str) -> DataFrame:
    """Closed windows, as ``lod_pyramid`` gives them."""
    return spark.read.parquet(path).where("level >= 0").select(*SIGNAL_KEY, "level", "bucket", "window_start", "cycle", "raw_bits", "state")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """Refused rows with their reason."""
    return spark.read.parquet(path).where("level < 0").select(*SIGNAL_KEY, "cycle", "raw_bits", "state", "reason")
