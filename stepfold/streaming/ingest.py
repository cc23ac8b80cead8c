"""Streaming ingest: guard the updates, emit changes only, set late and bad rows aside.

The last value of each signal is Spark's keyed state, committed with the query's checkpoint: a batch that is killed is repeated from the
same state, and the sink's log shows each batch once. Rows that can be judged by themselves are, before they move; all others go to their
signal's state. A batch brings the rows of 256 signals with neighbouring ids into one call, so its size bounds that call; limit it with the source's rate.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stepfold.operators.checks import known_storages, update_rules
from stepfold.schema import SAMPLES
from stepfold.streaming.state import ADDED, REMOVED, SHARED_BITS, LastValues, keyed_state

KEY = ["trace_id", "storage_id"]
#: Updates and the events in the life of their signals.
UPDATES = T.StructType([*SAMPLES.fields, T.StructField("event", T.StringType())])
ALL_THERE_IS = {"availableNow": True}
_OUT = "trace_id string, storage_id long, cycle long, seq long, raw_bits long, state byte, reason string, missing int"


def replay(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Stream of a folder of Parquet files in the order they were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def lifecycle_events(signals: DataFrame) -> DataFrame:
    """The events of signals (trace_id, storage_id, since_cycle, initial_bits, until_cycle) as rows of UPDATES.

    A signal is added at ``since_cycle``, 0 if that is null, before that cycle's updates, and removed at ``until_cycle``, if there is one, after them.
    """
    def rows(cycle: Column, seq: int, bits: Column, event: str) -> DataFrame:
        return signals.select(*KEY, cycle.cast("bigint").alias("cycle"), F.lit(seq).cast("bigint").alias("seq"), bits.cast("bigint").alias("raw_bits"),
                              F.lit(0).cast("tinyint").alias("state"), F.lit(event).alias("event"))

    zero = F.lit(0)
    added = rows(F.coalesce("since_cycle", zero), -1, F.coalesce("initial_bits", zero), ADDED)
    return added.unionByName(rows(F.col("until_cycle"), (1 << 63) - 1, zero, REMOVED).where("cycle IS NOT NULL"))


def judged(updates: DataFrame, signals: DataFrame | None = None, clocks: DataFrame | None = None, declared: bool = False) -> DataFrame:
    """Changes (``reason`` null, no ``seq``) and refused rows of a stream of updates.

    Refused are, with the first reason that holds: rows with a null (incomplete), those that break the layout rules if ``signals`` and
    ``clocks`` are given, those before their signal's declared ``since_cycle`` (not_added), and what ``judge_signals`` refuses.
    """
    rows = updates if "event" in updates.columns else updates.withColumn("event", F.lit(None).cast("string"))
    named = ["trace_id", "storage_id", "cycle", "seq", "raw_bits", "state"]
    missing = reduce(Column.__add__, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(named)])
    rows = rows.withColumn("missing", missing)
    rules: dict[str, Column] = {"incomplete": F.col("missing") != 0}
    update = F.col("event").isNull()
    if signals is not None:
        layout = signals.groupBy(*KEY).agg(F.max("initial_bits").alias("initial_bits"), F.min(F.coalesce("since_cycle", F.lit(0))).alias("since_cycle"))
        if clocks is not None:
            layout = layout.join(known_storages(signals, clocks), KEY)
            rules |= {name: test & update for name, test in update_rules().items() if name != "state_not_known"}
        rows = rows.join(layout, KEY, "left")
        rules["not_added"] = update & F.coalesce(F.col("cycle") < F.col("since_cycle"), F.lit(False))
    else:
        rows = rows.withColumn("initial_bits", F.lit(None).cast("bigint"))
    reason = F.get(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])), F.lit(0))
    # Without nulls in numbers, so that all 64 bits survive the way to Python; ``missing`` tells where they were.
    kinds = {f.name: f.dataType for f in SAMPLES}
    filled = [F.coalesce(c, F.lit("" if c == "trace_id" else 0).cast(kinds[c])).alias(c) for c in named]
    rows = rows.select(*filled, "event", "missing", F.coalesce("initial_bits", F.lit(0).cast("bigint")).alias("initial_bits"), reason.alias("reason"))
    out = rows.withColumn("shared", F.shiftright("storage_id", SHARED_BITS)).groupBy("trace_id", "shared").transformWithStateInPandas(LastValues(declared), _OUT, outputMode="Append", timeMode="None")
    restored = [F.when(F.col("missing").bitwiseAND(1 << i) == 0, F.col(c)).alias(c) for i, c in enumerate(named)]
    return out.select(*restored, "reason")


def stream_changes(updates: DataFrame, path: str, signals: DataFrame | None = None, clocks: DataFrame | None = None, declared: bool = False,
                   trigger: Mapping[str, object] = ALL_THERE_IS) -> StreamingQuery:
    """Run updates (trace_id, storage_id, cycle, seq, raw_bits, state and, optionally, event) into changes and refused rows under ``path``.

    ``event`` adds a signal with its starting value or removes it (see ``lifecycle_events``); with ``declared``, signals are absent until added. With
    ``signals`` and ``clocks`` the layout rules apply as well, and a stream that isn't added starts from its declared value.
    ``trigger`` is that of ``DataStreamWriter.trigger``: all there is, or for instance every few seconds.
    """
    rows = judged(updates, signals, clocks, declared).withColumn("refused", F.col("reason").isNotNull())
    with keyed_state(updates.sparkSession):
        return (rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
                .partitionBy("refused").trigger(**trigger).start())


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").where("NOT boolean(refused)").select(*KEY, "cycle", "raw_bits", "state")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").where("boolean(refused)").drop("refused")
