"""Change events: compaction, change times, segments and value projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.functions.bits import mask_of, slice_bits
from stepfold.operators.blocks import SPANS, dense_keys, next_, place, prev, scan, spread_join
from stepfold.schema import HIGH_Z, KNOWN, SIGNAL_KEY, same, state

PREV = [prev("raw_bits", "prev_bits"), prev("state", "prev_state")]


def _is_change() -> Column:
    """The row has no predecessor, or differs from it in state or bits."""
    return F.col("prev_state").isNull() | ~same(
        F.col("raw_bits"), F.col("state"), F.col("prev_bits"), F.col("prev_state"))


def last_writes(samples: DataFrame, signal: str = "storage_id") -> DataFrame:
    """One row per (signal, cycle): the write with the highest ``seq``.

    ``max_by`` of plain columns keeps this a hash aggregate with a map-side half, so repeated
    writes of a cycle collapse before the shuffle.
    """
    return samples.groupBy("trace_id", signal, "cycle").agg(
        F.max_by("raw_bits", "seq").alias("raw_bits"),
        F.max_by("state", "seq").alias("state"))


def drop_repeats(rows: DataFrame, signal: str = "signal_id", spans: Sequence[int] = SPANS) -> DataFrame:
    """Drop rows equal to the row before; ``rows`` has one row per (signal, cycle)."""
    scanned = scan(rows, ["trace_id", signal], "cycle", PREV, spans)
    return scanned.where(_is_change()).drop("prev_bits", "prev_state")


def compact_changes(samples: DataFrame, signal: str = "storage_id",
                    spans: Sequence[int] = SPANS) -> DataFrame:
    """Raw updates in any order to changes: last write per cycle, repeats dropped.

    The result is the normal form: no row equals its predecessor, even after a same-cycle rewrite.
    Writes of a cycle collapse before the shuffle where a signal has more samples than a block may
    hold; other signals move once, as they are, and collapse beside their neighbours.
    """
    if not spans:
        return drop_repeats(last_writes(samples, signal), signal, spans)
    key = ["trace_id", signal]
    rows = samples.select(*key, "cycle", "seq", "raw_bits", "state")
    dense = dense_keys(rows, key, spans[0])
    last = [F.max_by("raw_bits", "seq").alias("raw_bits"), F.max_by("state", "seq").alias("state")]
    many = rows.join(F.broadcast(dense), key).groupBy(*key, "cycle").agg(F.max("seq").alias("seq"), *last)
    few = rows.join(F.broadcast(dense), key, "left_anti")
    placed, block = place(few.unionByName(many), key, "cycle", dense, spans[0])
    # The order by (cycle, seq) that finds a cycle's last write serves the scan, too.
    ordered = Window.partitionBy(*key, block).orderBy("cycle", "seq")
    later = placed.withColumns({"__more": F.lead(F.lit(True)).over(ordered), "__after": F.lead("cycle").over(ordered)})
    kept = later.where(F.col("__more").isNull() | ~F.col("cycle").eqNullSafe(F.col("__after")))
    written = kept.withColumns({c: F.when(F.col("seq").isNotNull(), F.col(c)) for c in ("raw_bits", "state")})
    scanned = scan(written.drop("seq", "__more", "__after"), key, "cycle", PREV, spans, dense=dense)
    return scanned.where(_is_change()).drop("prev_bits", "prev_state")


def starting_values(signals: DataFrame) -> DataFrame:
    """The value each visible signal holds when it appears: zero at cycle 0 unless declared later."""
    return signals.where(~F.coalesce("storage_only", F.lit(False))).select(
        "trace_id", "signal_id",
        F.coalesce("since_cycle", F.lit(0)).cast("bigint").alias("cycle"),
        F.coalesce("initial_bits", F.lit(0)).cast("bigint").alias("raw_bits"),
        state(KNOWN).alias("state"))


def implicit_zero(transitions: DataFrame, signals: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """Add the starting value of every signal that has no event of its own at that cycle."""
    seeds = starting_values(signals)
    # The seeds are the small side of the first join, so the events need not move for it; what it
    # keeps is at most one event per signal.
    at = [*SIGNAL_KEY, "cycle"]
    taken = transitions.select(*at).join(seeds.select(*at), at, "left_semi")
    missing = seeds.join(taken, at, "left_anti")
    columns = [*SIGNAL_KEY, "cycle", "raw_bits", "state"]
    return drop_repeats(transitions.select(*columns).unionByName(missing.select(*columns)), spans=spans)


def change_times(transitions: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """Cycles where a sample differs from the one before; the first sample is not a change."""
    scanned = scan(transitions, SIGNAL_KEY, "cycle", PREV, spans)
    return scanned.where(F.col("prev_state").isNotNull() & _is_change()).select(*SIGNAL_KEY, "cycle")


def segments(transitions: DataFrame, meta: DataFrame, window: tuple[int, int] | None = None,
             spans: Sequence[int] = SPANS) -> DataFrame:
    """Events to intervals ``[cycle, end)``; the last one ends with the trace.

    ``window`` clips to a viewport. The previous event's value is kept as ``prev_bits`` and
    ``prev_state`` for users that draw the edge between two segments.
    """
    scanned = scan(transitions, SIGNAL_KEY, "cycle", [*PREV, next_("cycle", "end")], spans)
    # Header rows, one per trace: Spark broadcasts a small table of them, and splits a hot trace where it is large.
    out = scanned.join(meta.select("trace_id", F.col("end").alias("__trace_end")), "trace_id")
    out = out.withColumn("end", F.least(F.coalesce("end", "__trace_end"), "__trace_end")).drop("__trace_end")
    if window is not None:
        lo, hi = window
        out = out.withColumns({"start": F.greatest("cycle", F.lit(lo)), "end": F.least("end", F.lit(hi))})
    else:
        out = out.withColumn("start", F.col("cycle"))
    return out.where("end > start").select(
        *SIGNAL_KEY, "cycle", "start", "end", "raw_bits", "state", "prev_bits", "prev_state")


def scale_cycles(samples: DataFrame, period: int | None) -> DataFrame:
    """Business cycles to ticks of the default clock; ANSI arithmetic fails on overflow."""
    if period is None:
        return samples
    return samples.withColumn("cycle", F.col("cycle") * F.lit(period).cast("bigint"))


def bool_storage(samples: DataFrame) -> DataFrame:
    """Byte-stored booleans: any non-zero byte is true."""
    return samples.withColumn("raw_bits", (F.col("raw_bits") != 0).cast("bigint"))


def bit_slice(samples: DataFrame, signals: DataFrame) -> DataFrame:
    """Logical values of the signals that share a storage stream, one row per signal and sample."""
    logical = signals.where(~F.coalesce("storage_only", F.lit(False))).select(
        "trace_id", "storage_id", "signal_id", "width", "bit_offset")
    joined = spread_join(samples, logical, ["trace_id", "storage_id"], "cycle")
    sliced = slice_bits(F.col("raw_bits"), F.col("bit_offset"), F.col("width"))
    return joined.withColumn("raw_bits", F.when(F.col("state") == KNOWN, sliced).otherwise(F.col("raw_bits")))


def fan_out_aliases(samples: DataFrame, signals: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """Storage streams to the logical signals on them, keeping only changes of the slice.

    The predecessor is looked up once per storage row and sliced along with the row, so aliases
    need no second window.
    """
    stored = scan(last_writes(samples), ["trace_id", "storage_id"], "cycle", PREV, spans)
    logical = signals.where(~F.coalesce("storage_only", F.lit(False))).select(
        "trace_id", "storage_id", "signal_id", "width", "bit_offset")
    joined = spread_join(stored, logical, ["trace_id", "storage_id"], "cycle")

    def view(bits: str, st: str) -> Column:
        sliced = slice_bits(F.col(bits), F.col("bit_offset"), F.col("width"))
        return F.when(F.col(st) == KNOWN, sliced).otherwise(F.col(bits))

    joined = joined.withColumns({"raw_bits": view("raw_bits", "state"),
                                 "prev_bits": view("prev_bits", "prev_state")})
    return joined.where(_is_change()).select(*SIGNAL_KEY, "cycle", "raw_bits", "state")


def sanitize_no_z(transitions: DataFrame, signals: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """Export clean-up: Z becomes 0, one-bit signals keep bit 0, absent rows stay as they are."""
    kinds = signals.select(*SIGNAL_KEY, "kind", "width")
    stored = scan(transitions, SIGNAL_KEY, "cycle", PREV, spans)
    joined = spread_join(stored, kinds, SIGNAL_KEY, "cycle")

    def clean(bits: str, st: str) -> Column:
        kept = F.col(bits).bitwiseAND(F.when(F.col("kind") == "bit", F.lit(1).cast("bigint"))
                                      .otherwise(mask_of(F.col("width"))))
        return (F.when(F.col(st) == HIGH_Z, F.lit(0).cast("bigint"))
                .when(F.col(st) == KNOWN, kept).otherwise(F.col(bits)))

    def no_z(st: str) -> Column:
        return F.when(F.col(st) == HIGH_Z, state(KNOWN)).otherwise(F.col(st))

    cleaned = joined.withColumns({"raw_bits": clean("raw_bits", "state"),
                                  "prev_bits": clean("prev_bits", "prev_state")})
    cleaned = cleaned.withColumns({"state": no_z("state"), "prev_state": no_z("prev_state")})
    return cleaned.where(_is_change()).select(*SIGNAL_KEY, "cycle", "raw_bits", "state")


def depth_limit(signals: DataFrame, limit: int | str | None) -> DataFrame:
    """Keep signals whose path has at most ``limit`` dots; unset, 0 or non-numeric is no limit."""
    text = "" if limit is None else str(limit)
    if not (text.isascii() and text.isdigit()) or int(text) == 0:
        return signals
    dots = F.length("path") - F.length(F.replace("path", F.lit("."), F.lit("")))
    return signals.where(dots <= int(text))
