"""Tiles written by a stream batch by batch, and their rewriting into one file each once they are closed.

    appended/batch=n    what batch n of the stream brought, by tile
    log/appended        one row for each batch that is complete
    closed/rewrite=n    tiles put together by rewrite n, one file each
    log/rewrite=n       as of rewrite n: which rewrite holds each closed tile, and up to which batch it has their rows

Stream and rewrite each write to a log of their own, so neither waits for the other. A batch or a rewrite is written first and logged
last, as one file; until then nobody reads it, and its repetition replaces it. A reader takes closed tiles from the last rewrite, and from the batches
all rows that this one doesn't hold: every row once, also those that come late for a tile that is closed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepfold.schema import TILE_CYCLES, TILE_SIGNALS, TRANSITIONS
from stepfold.sources.tiles import TASKS_COMMIT, with_tiles
from stepfold.streaming.ingest import ALL_THERE_IS

TILE = ["time_block", "signal_chunk"]
_APPENDED, _REWRITTEN = "batch long, blocks long", "time_block long, signal_chunk long, held_by long, upto long"
_ROWS = TRANSITIONS.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", ")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _write_tiles(rows: DataFrame, path: str) -> None:
    """One file for each tile, sorted by signal and cycle; what stood there before is replaced.

    Tasks put their own files into place: nobody reads them before the log, so the driver need not move each one at the end.
    """
    (rows.repartition(*TILE).sortWithinPartitions(*TILE, "signal_id", "cycle").write.mode("overwrite")
     .option("compression", "zstd").options(**TASKS_COMMIT).partitionBy(*TILE).parquet(path))


def stream_appended(changes: DataFrame, path: str, checkpoint: str, span: int = TILE_CYCLES, chunk: int = TILE_SIGNALS,
                    trigger: Mapping[str, object] = ALL_THERE_IS) -> StreamingQuery:
    """Write the changes of each batch by tile, then log the batch. A batch that is repeated replaces what it wrote and is logged again."""
    def handle(batch: DataFrame, number: int) -> None:
        _write_tiles(with_tiles(batch.select(*TRANSITIONS.names), span=span, chunk=chunk), f"{path}/appended/batch={number}")
        batch.sparkSession.createDataFrame([(number, span)], _APPENDED).coalesce(1).write.mode("append").parquet(f"{path}/log/appended")

    return changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Complete batches; a number for each."""
    return sorted(r["batch"] for r in _read(spark, f"{path}/log/appended", _APPENDED).select("batch").distinct().collect())


def _appended(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    rows = _read(spark, f"{path}/appended", f"{_ROWS}, batch long, time_block long, signal_chunk long")
    return rows.where(F.col("batch").isin(batches)) if batches else rows.limit(0)


def _last_rewrite(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Its number, -1 without any, and the tiles that are closed as of it."""
    logs = _read(spark, f"{path}/log/closed", f"{_REWRITTEN}, rewrite long")
    number = logs.agg(F.max("rewrite")).first()[0]
    return (-1 if number is None else number), logs.where(F.col("rewrite") == number).drop("rewrite")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """All rows of complete batches, once, with their tile."""
    columns = [*TRANSITIONS.names, *TILE]
    # The logs are read in this order: a batch that is logged later is in no rewrite that was found before.
    _, closed = _last_rewrite(spark, path)
    rows = _appended(spark, path, _batches(spark, path))
    live = rows.join(closed.select(*TILE, "upto"), TILE, "left").where(F.col("upto").isNull() | (F.col("batch") > F.col("upto")))
    held = _read(spark, f"{path}/closed", f"{_ROWS}, rewrite long, time_block long, signal_chunk long")
    held = held.join(closed.select(*TILE, F.col("held_by").alias("rewrite")), [*TILE, "rewrite"])
    return live.select(*columns).unionByName(held.select(*columns))


def rewrite_closed(spark: SparkSession, path: str, ended: bool = False) -> int:
    """Put the tiles of all blocks but the last one, of that one too if the stream has ``ended``, into one file each; the number of tiles rewritten.

    Only tiles with rows in batches since the last rewrite are touched. Those that had late rows are put together again. A killed rewrite
    isn't logged; the next one has the same number and replaces it.
    """
    number, closed = _last_rewrite(spark, path)
    batches = _batches(spark, path)
    rows = _appended(spark, path, batches)
    # Files say which tiles there are: partition columns alone.
    tiles = rows.groupBy(*TILE).agg(F.max("batch").alias("upto"))
    if not ended:
        last = tiles.agg(F.max("time_block").alias("last"))
        tiles = tiles.join(last, tiles["time_block"] < last["last"]).select(*TILE, "upto")
    known = closed.select(*TILE, "held_by", F.col("upto").alias("before"))
    touched = tiles.join(known, TILE, "left").where(F.col("before").isNull() | (F.col("upto") > F.col("before"))).select(*TILE, "upto").cache()
    n = touched.count()
    if n:
        # Named, the blocks are a predicate on partitions: files of other blocks are not opened.
        blocks = [r["time_block"] for r in touched.select("time_block").distinct().collect()]
        whole = read_tiles(spark, path).where(F.col("time_block").isin(blocks)).join(touched.select(*TILE), TILE, "left_semi")
        _write_tiles(whole, f"{path}/closed/rewrite={number + 1}")
        new = touched.withColumn("held_by", F.lit(number + 1).cast("long")).select(*TILE, "held_by", "upto")
        kept = closed.join(touched.select(*TILE), TILE, "left_anti").select(*TILE, "held_by", "upto")
        new.unionByName(kept).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/closed/rewrite={number + 1}")
    touched.unpersist()
    return n
