"""Find values and neighbouring changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions.bits import lit64, mask_of
from stepfold.operators.blocks import SPANS, ahead, dense_keys, held, prev, scan, spread_join, total
from stepfold.plans.lineage import cut
from stepfold.schema import KNOWN, SIGNAL_KEY


def find_target(text: str) -> tuple[int, bool] | None:
    """A search text as (64-bit value, negative decimal), or None when it is not a number.

    This is one literal of the query, read before the job is planned.
    """
    raw = text.strip()
    body, base = raw, None
    if raw.startswith("-"):
        body, base = raw[1:], 10
    elif raw[:2].lower() == "0x":
        body, base = raw[2:], 16
    elif raw[:2].lower() == "0b":
        body, base = raw[2:], 2
    elif raw.isascii() and raw.isdigit():
        base = 10
    else:
        base = 16
    digits = "0123456789abcdef"[:base]
    if not body or any(c not in digits for c in body.lower()):
        return None
    value = int(body, base)
    if raw.startswith("-"):
        return (-value, True) if value <= 1 << 63 else None
    return (value, False) if value < 1 << 64 else None


def _target_bits(target: tuple[int, bool], width: Column) -> Column:
    """Target masked to the signal's width; null when a positive target does not fit."""
    value, negative = target
    masked = lit64(value).bitwiseAND(mask_of(width))
    return masked if negative else F.when(masked == lit64(value), masked)


def searched_signals(signals: DataFrame, text: str) -> DataFrame:
    """Each searched signal with the bits to look for, null where the target exceeds its width."""
    target = find_target(text)
    if target is None:
        raise ValueError(f"not a number: {text!r}")
    width = F.col("width")
    return signals.select(*SIGNAL_KEY, "path", "width", F.when(width > 0, _target_bits(target, width)).alias("target"))


def find_value(transitions: DataFrame, signals: DataFrame, text: str,
               spans: Sequence[int] = SPANS) -> DataFrame:
    """Start of every run of samples equal to the target, one hit per run."""
    wanted = searched_signals(signals, text).where("target IS NOT NULL").select(*SIGNAL_KEY, "width", "target")
    # Rows meet their target in the block in which they are scanned, so they move once.
    dense = cut(dense_keys(transitions, SIGNAL_KEY, spans[0])) if spans else None
    rows = spread_join(transitions, wanted, SIGNAL_KEY, "cycle", bits=spans[0] if spans else SPANS[0], dense=dense, keep=True)
    hit = (F.col("state") == KNOWN) & (F.col("raw_bits").bitwiseAND(mask_of(F.col("width"))) == F.col("target"))
    rows = rows.withColumns({"hit": hit.cast("int"), "one": F.lit(1).cast("bigint")}).drop("raw_bits", "state", "width", "target")
    ranked = scan(rows, SIGNAL_KEY, "cycle", [prev("hit", "was_hit"), total("one", "sample_index")], spans, dense=dense)
    return ranked.where("hit = 1 AND coalesce(was_hit, 0) = 0").select(*SIGNAL_KEY, "cycle", "sample_index")


def ordered_hits(hits: DataFrame) -> DataFrame:
    """Hits in time order, then signal order; a range shuffle, so no single task sorts them all."""
    return hits.orderBy("cycle", "signal_id", "sample_index")


def ordered_events(transitions: DataFrame) -> DataFrame:
    """Events of all signals merged in (time, signal) order."""
    return transitions.orderBy("cycle", "signal_id")


def value_find_summary(hits: DataFrame, transitions: DataFrame, signals: DataFrame, text: str) -> DataFrame:
    """Per searched signal: hits, first time (``-`` when none), samples, and whether it was skipped."""
    counted = hits.groupBy(*SIGNAL_KEY).agg(F.count("*").alias("hits"), F.min("cycle").alias("first"))
    sampled = transitions.groupBy(*SIGNAL_KEY).agg(F.count("*").alias("samples"))
    zero = F.lit(0).cast("bigint")
    return (searched_signals(signals, text).join(counted, SIGNAL_KEY, "left").join(sampled, SIGNAL_KEY, "left")
            .select(*SIGNAL_KEY, "path", F.coalesce("hits", zero).alias("hits"),
                    F.coalesce(F.col("first").cast("string"), F.lit("-")).alias("first_time"),
                    F.coalesce("samples", zero).alias("samples"),
                    F.col("target").isNull().alias("width_skipped")))


def value_find_totals(summary: DataFrame) -> DataFrame:
    """One row: total hits, matched and skipped signals, and the earliest hit (first signal on ties)."""
    first = F.expr("try_cast(first_time AS BIGINT)")
    earliest = F.min(F.when(F.col("hits") > 0, F.struct(first.alias("cycle"), F.col("signal_id")))).alias("e")
    return summary.agg(
        F.coalesce(F.sum("hits"), F.lit(0)).cast("bigint").alias("total_hits"),
        F.count(F.when(F.col("hits") > 0, 1)).alias("matched_signals"),
        F.count(F.when(F.col("width_skipped"), 1)).alias("skipped_signals"),
        earliest).select("total_hits", "matched_signals", "skipped_signals",
                         F.col("e.cycle").alias("first_cycle"), F.col("e.signal_id").alias("first_signal_id"))


def write_find_csv(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def _neighbour(marks: DataFrame, probes: DataFrame, forward: bool, inclusive: bool,
               spans: Sequence[int]) -> DataFrame:
    """For each probe (trace_id, cycle) the nearest mark after or before it; none gives no row."""
    at = ["trace_id", "cycle"]
    # One column tells marks (bit 0) from probes (bit 1), so rows and edges of the scan share an aggregate.
    rows = (marks.select(*at, F.lit(1).alias("kind")).unionByName(probes.select(*at, F.lit(2).alias("kind")))
            .groupBy(*at).agg(F.bit_or("kind").alias("kind"))
            .withColumn("at", F.when(F.col("kind").bitwiseAND(1) > 0, F.col("cycle"))))
    near = scan(rows, ["trace_id"], "cycle", [(ahead if forward else held)("at", "near")], spans)
    target = F.coalesce("at", "near") if inclusive else F.col("near")
    return near.where(F.col("kind") >= 2).select(*at, target.alias("target")).where("target IS NOT NULL")


def _changes(transitions: DataFrame) -> DataFrame:
    """Change times of compacted transitions: every row but each signal's first.

    The first times are one row per signal, so the anti join need not move the transitions.
    """
    first = transitions.groupBy(*SIGNAL_KEY).agg(F.min("cycle").alias("cycle"))
    return transitions.join(first, [*SIGNAL_KEY, "cycle"], "left_anti")


def next_change(transitions: DataFrame, probes: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """Over all given signals, the first change strictly after each probe."""
    return _neighbour(_changes(transitions), probes, True, False, spans)


def prev_change(transitions: DataFrame, probes: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """Over all given signals, the last change strictly before each probe."""
    return _neighbour(_changes(transitions), probes, False, False, spans)


def next_diff(regions: DataFrame, probes: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """First region start strictly after each probe."""
    return _neighbour(regions.withColumn("cycle", F.col("start")), probes, True, False, spans)


def prev_diff(regions: DataFrame, probes: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """Last region start at or before each probe; staying in place is allowed."""
    return _neighbour(regions.withColumn("cycle", F.col("start")), probes, False, True, spans)


def union_times(transitions: DataFrame) -> DataFrame:
    """Sorted distinct change times over the given signals."""
    return transitions.select("trace_id", "cycle").distinct().orderBy("trace_id", "cycle")


__all__ = ["find_target", "find_value", "ordered_hits", "ordered_events", "value_find_summary",
           "value_find_totals", "write_find_csv", "next_change", "prev_change", "next_diff", "prev_diff",
           "union_times", "searched_signals"]
