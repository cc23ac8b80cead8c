"""Derived signals: an expression over other signals, evaluated at every change of any of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions.bits import Bits, mask
from stepfold.functions.names import strip_range
from stepfold.operators.blocks import SPANS
from stepfold.operators.joins import merge_states
from stepfold.schema import HIGH_Z, KNOWN, state


def derive_signal(transitions: DataFrame, deps: DataFrame, meta: DataFrame, widths: Sequence[int],
                  expression: Callable[..., Bits], width: int | None = None,
                  spans: Sequence[int] = SPANS) -> DataFrame:
    """Transitions of one derived signal per group of ``deps`` (trace_id, group_id, slot, signal_id).

    ``expression`` takes one ``Bits`` per slot and is built from the ``u_*`` functions, so it stays
    a native column expression. The result is Z when it is not known. It is evaluated at the trace
    start and at each change; because the merge also gives the state just before each row, repeats
    are recognised on the row itself and need no second window.
    """
    slots = len(widths)
    groups = deps.select("trace_id", "group_id").distinct()
    starts = groups.join(meta.select("trace_id", F.col("start").alias("cycle")), "trace_id")
    merged = merge_states(transitions, deps, slots, starts, spans)

    # Header rows, one per trace: Spark broadcasts a small table of them, and splits a hot trace where it is large.
    at_start = merged.join(meta.select("trace_id", F.col("start").alias("__start")), "trace_id")
    rows = at_start.where(F.col("cycle") >= F.col("__start"))

    def evaluate(side: str) -> tuple[Column, Column]:
        operands = [Bits(F.when(F.col(f"{side}state_{i}") == KNOWN, F.col(f"{side}bits_{i}").bitwiseAND(mask(w))),
                         min(max(w, 1), 64)) for i, w in enumerate(widths)]
        result = expression(*operands)
        bits = result.resize(width or result.width).bits
        return (F.coalesce(bits, F.lit(0).cast("bigint")),
                F.when(bits.isNull(), state(HIGH_Z)).otherwise(state(KNOWN)))

    (bits, known), (prev_bits, prev_known) = evaluate(""), evaluate("prev_")
    changed = (F.col("cycle") == F.col("__start")) | (bits != prev_bits) | (known != prev_known)
    return rows.where(changed).select("trace_id", "group_id", "cycle", bits.alias("raw_bits"), known.alias("state"))


def derived_definition(expression: Callable[..., Bits], widths: Sequence[int], width: int | None = None) -> dict:
    """Kind, width and radix of the derived signal."""
    result = expression(*[Bits(F.lit(0).cast("bigint"), w) for w in widths])
    w = min(max(width or result.width, 1), 64)
    return {"width": w, "kind": "bit" if w <= 1 else "bus", "radix": "bin" if w <= 1 else "hex"}


def name_is_new(names: DataFrame, signals: DataFrame) -> DataFrame:
    """For each proposed (trace_id, name): whether no signal has it yet."""
    taken = signals.select("trace_id", strip_range(F.col("path")).alias("key"), F.lit(True).alias("taken")).distinct()
    keyed = names.withColumn("key", strip_range(F.col("name")))
    return keyed.join(taken, ["trace_id", "key"], "left").select("trace_id", "name", F.col("taken").isNull().alias("is_new"))
