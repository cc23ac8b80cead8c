"""Table layouts and the constants every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Event states.
KNOWN, HIGH_Z, ABSENT = 0, 1, 2

# Bits of the per-bucket state mask.
SEEN_ZERO, SEEN_NONZERO, SEEN_Z, SEEN_ABSENT = 1, 2, 4, 8

# Capacity in bits of each stored value type.
TYPE_BITS = {
    "Bool": 8, "I8": 8, "U8": 8, "I16": 16, "U16": 16, "I32": 32, "U32": 32,
    "I64": 64, "U64": 64, "F32": 32, "F64": 64,
}

# Defaults of the trace header.
DEFAULT_TITLE, DEFAULT_TIMESCALE, DEFAULT_START, DEFAULT_END = "custom_wave", "1ns", 0, 100

# Default tile size.
TILE_CYCLES, TILE_SIGNALS = 100_000, 1024

SIGNAL_KEY = ["trace_id", "signal_id"]

SIGNALS = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("signal_id", T.LongType()),
    T.StructField("storage_id", T.LongType()),
    T.StructField("node_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("bit_offset", T.IntegerType()),
    T.StructField("value_type", T.StringType()),
    T.StructField("radix", T.StringType()),
    T.StructField("storage_only", T.BooleanType()),
    T.StructField("since_cycle", T.LongType()),
    T.StructField("initial_bits", T.LongType()),
])

NODES = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("node_id", T.LongType()),
    T.StructField("parent_id", T.LongType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("node_kind", T.StringType()),
])

SAMPLES = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("storage_id", T.LongType()),
    T.StructField("cycle", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("raw_bits", T.LongType()),
    T.StructField("state", T.ByteType()),
])

TRANSITIONS = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("signal_id", T.LongType()),
    T.StructField("cycle", T.LongType()),
    T.StructField("raw_bits", T.LongType()),
    T.StructField("state", T.ByteType()),
])

CLOCKS = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("signal_id", T.LongType()),
    T.StructField("initial_value", T.BooleanType()),
    T.StructField("period_ticks", T.LongType()),
])

TRACE_META = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("timescale", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
])

REGIONS = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
])


def state(value: int) -> Column:
    return F.lit(value).cast("tinyint")


def same(bits_a: Column, state_a: Column, bits_b: Column, state_b: Column) -> Column:
    """Two events are equal when their states and their bit patterns are equal."""
    return (state_a == state_b) & (bits_a == bits_b)
