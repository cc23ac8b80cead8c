"""Joins over step functions: as-of lookups, temporal merges, interval overlap, name resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.functions.names import leaf_of, strip_range
from stepfold.operators.blocks import SPANS, held, scan, spread_join
from stepfold.schema import ABSENT, SIGNAL_KEY, state


def value_at(transitions: DataFrame, probes: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """As-of join: the value of each probed (signal, cycle), absent before the first event.

    Events and probes are folded to one row per (signal, cycle) and scanned together, which costs
    one sort however many probes there are. Returns one row per distinct probe.
    """
    at = [*SIGNAL_KEY, "cycle"]
    nothing = F.lit(None)
    events = transitions.select(*at, "raw_bits", "state", nothing.cast("int").alias("asked"))
    # Distinct first, so that at most one event and one probe meet in a cycle.
    asked = probes.select(*at).distinct().select(
        *at, nothing.cast("bigint").alias("raw_bits"), nothing.cast("tinyint").alias("state"), F.lit(1).alias("asked"))
    found = scan(events.unionByName(asked), SIGNAL_KEY, "cycle",
                 [held("raw_bits", "held_bits"), held("state", "held_state")], spans,
                 fold=[F.max(c).alias(c) for c in ("raw_bits", "state", "asked")])
    return found.where("asked = 1").select(
        *at,
        F.coalesce("raw_bits", "held_bits", F.lit(0).cast("bigint")).alias("raw_bits"),
        F.coalesce("state", "held_state", state(ABSENT)).alias("state"))


def common_signals(left: DataFrame, right: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Signals of traces of two sides matched on full path; the first of equal paths wins, empty ones drop.

    Traces of equal id are matched, or those that ``traces`` pairs (trace_id, b_trace_id).
    """

    def first_of_path(signals: DataFrame, side: str) -> DataFrame:
        # min_by keeps a map-side half, where row_number would sort every path.
        return signals.where(F.length("path") > 0).groupBy("trace_id", "path").agg(
            F.min("signal_id").alias(f"{side}_signal_id"),
            F.min_by("kind", "signal_id").alias(f"{side}_kind"),
            F.min_by("width", "signal_id").alias(f"{side}_width"))

    a, b = first_of_path(left, "a"), first_of_path(right, "b").withColumnRenamed("trace_id", "b_trace_id")
    if traces is None:
        return a.join(b.withColumn("trace_id", F.col("b_trace_id")), ["trace_id", "path"])
    return a.join(traces.select("trace_id", "b_trace_id"), "trace_id").join(b, ["b_trace_id", "path"])


def merge_states(transitions: DataFrame, deps: DataFrame, slots: int, starts: DataFrame | None = None,
                 spans: Sequence[int] = SPANS) -> DataFrame:
    """Temporal full outer merge: at each time any member changes, the value of all of them.

    ``deps`` has (trace_id, group_id, slot, signal_id); slots run from 0 to ``slots - 1``. ``starts``
    may add one time per group, (trace_id, group_id, cycle), at which the group is evaluated too.
    Columns ``bits_i, state_i`` hold the state at the row, ``prev_bits_i, prev_state_i`` the state
    just before it.
    """
    members = spread_join(transitions, deps.select("trace_id", "signal_id", "group_id", "slot"),
                          SIGNAL_KEY, "cycle")
    at = ["trace_id", "group_id", "cycle"]
    rows = members.select(*at, "slot", "raw_bits", "state")
    if starts is not None:
        rows = rows.unionByName(starts.select(*at), allowMissingColumns=True)

    def of_slot(i: int, column: str) -> Column:
        return F.max(F.when(F.col("slot") == i, F.col(column)))

    # A cycle has at most one row per slot and one start.
    wide = [*[of_slot(i, "raw_bits").alias(f"__b{i}") for i in range(slots)],
            *[of_slot(i, "state").alias(f"__s{i}") for i in range(slots)]]
    carries = [c for i in range(slots) for c in
               (held(f"__b{i}", f"prev_bits_{i}"), held(f"__s{i}", f"prev_state_{i}"))]
    merged = scan(rows, ["trace_id", "group_id"], "cycle", carries, spans, fold=wide)
    zero, absent = F.lit(0).cast("bigint"), state(ABSENT)
    return merged.select(*at, *[c for i in range(slots) for c in (
        F.coalesce(f"__b{i}", f"prev_bits_{i}", zero).alias(f"bits_{i}"),
        F.coalesce(f"__s{i}", f"prev_state_{i}", absent).alias(f"state_{i}"),
        F.coalesce(f"prev_bits_{i}", zero).alias(f"prev_bits_{i}"),
        F.coalesce(f"prev_state_{i}", absent).alias(f"prev_state_{i}"))])


def select_semi(rows: DataFrame, selection: DataFrame, on: Sequence[str] = ("trace_id", "signal_id")) -> DataFrame:
    """Rows touched by a selection; a hot signal is split by cycle."""
    return spread_join(rows, selection, on, "cycle", "left_semi")


def tiles_for(tiles: DataFrame, signals: DataFrame, chunk: int) -> DataFrame:
    """Tiles whose signal chunk holds one of the selected storage streams."""
    chunks = signals.select("trace_id", F.expr(f"(storage_id - 1) div {chunk}").alias("signal_chunk"))
    return tiles.join(chunks, ["trace_id", "signal_chunk"], "left_semi")


def clip_regions(regions: DataFrame, windows: DataFrame, keys: Sequence[str], tile: int = 1 << 16) -> DataFrame:
    """Interval overlap join: regions that meet a window ``[start, end)``, clipped to it.

    Cells come in levels, of ``tile`` cycles and 16 times as many each. An interval stands in the
    cells, 17 at most, of its own level, the lowest at which they are so few, and in those of the
    levels above, two each. Two intervals meet at the higher of their own levels, once, in the cell where
    their overlap begins. So an interval costs a few dozen rows however long it is, and the join is an equi
    join spread over time.
    """
    base = tile.bit_length() - 1
    levels = list(range(base, 63, 4))

    def cells(df: DataFrame, start: str, end: str, own: bool | None) -> DataFrame:
        """Cells at the own level, above it, or both (None)."""
        df = df.where(F.col(end) > F.col(start))
        last = F.col(end) - 1
        level = F.lit(levels[-1])
        for n in reversed(levels[:-1]):
            level = F.when(F.shiftright(last, n) - F.shiftright(F.col(start), n) <= 16, n).otherwise(level)
        at = df.withColumn("__own", level).withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels])))
        kept = {True: F.col("__level") == F.col("__own"), False: F.col("__level") > F.col("__own"),
                None: F.col("__level") >= F.col("__own")}[own]

        def cell(t: Column) -> Column:
            return F.call_function("shiftright", t, F.col("__level"))

        return at.where(kept).withColumn("__cell", F.explode(F.sequence(cell(F.col(start)), cell(last)))).drop("__own")

    named = windows.withColumnsRenamed({"start": "w_start", "end": "w_end"})
    at = [*keys, "__level", "__cell"]
    pairs = cells(regions, "start", "end", None).join(cells(named, "w_start", "w_end", True), at).unionByName(
        cells(regions, "start", "end", True).join(cells(named, "w_start", "w_end", False), at))
    lo, hi = F.greatest("start", "w_start"), F.least("end", "w_end")
    once = pairs.where("start < w_end AND end > w_start").where(
        F.call_function("shiftright", lo, F.col("__level")) == F.col("__cell"))
    return once.withColumns({"clip_start": lo, "clip_end": hi}).drop("__level", "__cell")


def resolve_names(names: DataFrame, signals: DataFrame) -> DataFrame:
    """Names to signals: full path first, else unique leaf; ``status`` tells the rest.

    ``names`` has (trace_id, name). A name that matches several signals is ``ambiguous``, one that
    matches none ``unknown``, one that is empty ``empty``.
    """
    keyed = names.withColumn("key", strip_range(F.col("name")))

    def index(path: Column, prefix: str) -> DataFrame:
        return (signals.select("trace_id", path.alias("key"), "signal_id").where(F.length("key") > 0)
                .groupBy("trace_id", "key").agg(
                    F.min("signal_id").alias(f"{prefix}_id"),
                    (F.min("signal_id") != F.max("signal_id")).alias(f"{prefix}_many")))

    bare = strip_range(F.col("path"))
    tried = (keyed.join(index(bare, "exact"), ["trace_id", "key"], "left")
             .join(index(leaf_of(bare), "leaf"), ["trace_id", "key"], "left"))
    status = (F.when(F.length("key") == 0, "empty")
              .when(F.col("exact_many"), "ambiguous")
              .when(F.col("exact_id").isNotNull(), "exact")
              .when(F.col("leaf_many"), "ambiguous")
              .when(F.col("leaf_id").isNotNull(), "leaf")
              .otherwise("unknown"))
    found = F.when(F.col("status") == "exact", F.col("exact_id")).when(F.col("status") == "leaf", F.col("leaf_id"))
    return tried.withColumn("status", status).select("trace_id", "name", found.alias("signal_id"), "status")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows per key; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


__all__ = ["value_at", "common_signals", "merge_states", "select_semi", "tiles_for", "clip_regions",
           "resolve_names", "first_per"]
