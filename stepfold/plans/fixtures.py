"""The given tables seen as traces: inputs of the registered queries, tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.schema import HIGH_Z, KNOWN, state

TRACE = "t"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update per event: the user is the signal, seconds since 2024 the cycle, cents the value."""
    is_z = F.col("event_type") == "error"
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.lit(TRACE).alias("trace_id"), (F.col("user_id") + 1).cast("bigint").alias("storage_id"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("bigint").alias("cycle"),
        F.col("event_id").cast("bigint").alias("seq"),
        F.when(is_z, F.lit(0).cast("bigint")).otherwise(cents).alias("raw_bits"),
        F.when(is_z, state(HIGH_Z)).otherwise(state(KNOWN)).alias("state"),
        "event_type")


def coarse(rows: DataFrame) -> DataFrame:
    """Hours instead of seconds: several writes of a signal share a cycle."""
    return rows.withColumn("cycle", F.call_function("div", F.col("cycle"), F.lit(3600).cast("bigint")))


def small(rows: DataFrame) -> DataFrame:
    """Two-bit values: many repeats."""
    return rows.withColumn("raw_bits", F.col("raw_bits") % 4)


def one_bit(rows: DataFrame) -> DataFrame:
    """A flag: is the event a purchase? Never Z."""
    return rows.withColumns({"raw_bits": (F.col("event_type") == "purchase").cast("bigint"), "state": state(KNOWN)})


def wide(rows: DataFrame) -> DataFrame:
    """64-bit patterns, most of them negative."""
    spread = F.col("raw_bits") * 1000003 - F.lit(25_000_000_000).cast("bigint")
    return rows.withColumn("raw_bits", F.when(F.col("state") == KNOWN, spread).otherwise(F.col("raw_bits")))


def as_signals(rows: DataFrame) -> DataFrame:
    """Samples whose storage streams are used as signals directly."""
    return rows.withColumnRenamed("storage_id", "signal_id")


def layout(spark: SparkSession, sf_dir: str, width: int, value_type: str = "U16", radix: str = "hex") -> DataFrame:
    """One signal per user, in eight groups."""
    i = F.col("signal_id")
    users = table(spark, sf_dir, "events").select((F.col("user_id") + 1).cast("bigint").alias("signal_id")).distinct()
    name = F.concat(F.lit("u"), i.cast("string"))
    return users.select(
        F.lit(TRACE).alias("trace_id"), "signal_id", i.alias("storage_id"), (i + 999).alias("node_id"), name.alias("name"),
        F.concat(F.lit("top.g"), (i % 8).cast("string"), F.lit("."), name).alias("path"),
        F.lit("bit" if width == 1 else "bus").alias("kind"), F.lit(width).alias("width"), F.lit(0).alias("bit_offset"),
        F.lit(value_type).alias("value_type"), F.lit(radix).alias("radix"), F.lit(False).alias("storage_only"),
        F.lit(0).cast("bigint").alias("since_cycle"), F.lit(0).cast("bigint").alias("initial_bits"))


def aliases(signals: DataFrame) -> DataFrame:
    """Two logical bytes per storage stream."""
    low, high = F.col("signal_id") * 2 - 1, F.col("signal_id") * 2
    return signals.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        "signal_id": F.when(F.col("half") == 0, low).otherwise(high), "bit_offset": F.col("half") * 8,
        "width": F.lit(8)}).drop("half")


def meta(rows: DataFrame, shorten: int = 0) -> DataFrame:
    """Header: from 0 to one cycle after the last event, or ``shorten`` cycles before that."""
    return rows.groupBy("trace_id").agg((F.max("cycle") + 1 - shorten).alias("end")).select(
        "trace_id", F.lit("events").alias("title"), F.lit("1s").alias("timescale"),
        F.lit(0).cast("bigint").alias("start"), "end")


def second_run(rows: DataFrame) -> DataFrame:
    """A run that differs: events missing, values changed, a signal in fifty gone."""
    changed = F.when((F.col("seq") % 101 == 0) & (F.col("state") == KNOWN), (F.col("raw_bits") + 1) % 4)
    return rows.where((F.col("seq") % 97 != 0) & ((F.col("storage_id") - 1) % 50 != 7)).withColumn(
        "raw_bits", F.coalesce(changed, F.col("raw_bits")))


def second_layout(signals: DataFrame) -> DataFrame:
    """Layout of the second run: its missing signals gone, and signal 3 wider than in the first."""
    return signals.where((F.col("signal_id") - 1) % 50 != 7).withColumn(
        "width", F.when(F.col("signal_id") == 3, 3).otherwise(F.col("width")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchy: top, regions, nations, one leaf per customer."""
    def level(name: str, node_id, parent_id, ordinal, label, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.lit(TRACE).alias("trace_id"), node_id.cast("bigint").alias("node_id"), parent_id.cast("bigint").alias("parent_id"),
            ordinal.cast("int").alias("ordinal"), label.alias("name"), F.lit(kind).alias("node_kind"))

    regions = level("region", 2 + F.col("r_regionkey"), F.lit(1), F.col("r_regionkey"), F.col("r_name"), "Object")
    top = table(spark, sf_dir, "region").groupBy().agg(F.lit(TRACE).alias("trace_id")).select(
        "trace_id", F.lit(1).cast("bigint").alias("node_id"), F.lit(0).cast("bigint").alias("parent_id"),
        F.lit(0).alias("ordinal"), F.lit("top").alias("name"), F.lit("Root").alias("node_kind"))
    nations = level("nation", 100 + F.col("n_nationkey"), 2 + F.col("n_regionkey"), F.col("n_nationkey"), F.col("n_name"), "Object")
    leaves = level("customer", 1000 + F.col("c_custkey"), 100 + F.col("c_nationkey"), F.col("c_custkey"), F.col("c_name"), "SignalLeaf")
    return top.unionByName(regions).unionByName(nations).unionByName(leaves)


def node_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 16-bit signal on each customer leaf: (trace_id, node_id, signal_id, width)."""
    return table(spark, sf_dir, "customer").select(
        F.lit(TRACE).alias("trace_id"), (1000 + F.col("c_custkey")).cast("bigint").alias("node_id"),
        (F.col("c_custkey") + 1).cast("bigint").alias("signal_id"), F.lit(16).alias("width"))


def order_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times to ask for, from order dates; the signal asked for follows the customer."""
    seconds = F.datediff(F.col("o_orderdate").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint") * 86400
    return table(spark, sf_dir, "orders").select(
        F.lit(TRACE).alias("trace_id"),
        (F.call_function("div", F.col("o_custkey").cast("bigint"), F.lit(10).cast("bigint")) + 1).alias("signal_id"),
        (F.pmod(seconds, F.lit(2_592_000).cast("bigint")) + F.pmod(F.col("o_orderkey").cast("bigint"), F.lit(86400).cast("bigint"))).alias("cycle"))
