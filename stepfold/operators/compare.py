"""Compare two traces: where do signals of the same path differ?"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions.names import side_path
from stepfold.operators.blocks import SPANS, dense_keys, held, next_, scan, spread_join
from stepfold.operators.joins import common_signals
from stepfold.operators.numbering import dense_number
from stepfold.plans.lineage import cut
from stepfold.schema import ABSENT, SIGNAL_KEY, same, state


def _pairs(meta_a: DataFrame, meta_b: DataFrame, traces: DataFrame | None) -> DataFrame:
    """Per compared trace, named by its left id: the right one, the range, and the end of each side."""
    if traces is None:
        traces = meta_a.select("trace_id", F.col("trace_id").alias("b_trace_id"))
    a = meta_a.select("trace_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = meta_b.select(F.col("trace_id").alias("b_trace_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    both = traces.select("trace_id", "b_trace_id").join(a, "trace_id").join(b, "b_trace_id")
    both = both.withColumn("lo", F.least("a_start", "b_start"))
    return both.select("trace_id", "b_trace_id", "lo", F.greatest("a_end", "b_end", F.col("lo") + 1).alias("hi"), "a_end", "b_end")


def diff_traces(a: DataFrame, signals_a: DataFrame, meta_a: DataFrame,
                b: DataFrame, signals_b: DataFrame, meta_b: DataFrame,
                spans: Sequence[int] = SPANS, traces: DataFrame | None = None) -> DataFrame:
    """Regions (trace_id, path, start, end), ``[start, end)``, in which traces of two sides differ.

    Traces of equal id are compared, or those that ``traces`` pairs (trace_id, b_trace_id), each left
    one once. A side is absent before its first event and from its own end on. Paths whose kind or
    width differ are one region over the whole range.
    """
    # One row per trace and common path, read by five branches below.
    common = cut(common_signals(signals_a, signals_b, traces).join(_pairs(meta_a, meta_b, traces), ["trace_id", "b_trace_id"]))
    comparable = (F.col("a_kind") == F.col("b_kind")) & (F.col("a_width") == F.col("b_width"))
    mismatched = common.where(~comparable).select("trace_id", "path", F.col("lo").alias("start"), F.col("hi").alias("end"))
    pairs = common.where(comparable).select("trace_id", "b_trace_id", "path", "a_signal_id", "b_signal_id", "lo", "hi", "a_end", "b_end")

    # A pair is split where one of its signals is dense; both sides of another have at most twice a block's rows.
    bits = spans[0] if spans else SPANS[0]
    crowded = {own: cut(dense_keys(rows, SIGNAL_KEY, bits)) for own, rows in (("a", a), ("b", b))} if spans else {}
    split = reduce(DataFrame.unionByName, [
        pairs.join(F.broadcast(keys.withColumnsRenamed({"trace_id": "of", "signal_id": "id"})),
                   (F.col("trace_id" if own == "a" else "b_trace_id") == F.col("of")) & (F.col(f"{own}_signal_id") == F.col("id")), "left_semi")
        .select("trace_id", F.col("a_signal_id").alias("pair")) for own, keys in crowded.items()]).distinct() if spans else None

    # The pair is keyed by the left signal's id, which is cheaper to shuffle than its path.
    def side(rows: DataFrame, own: str) -> DataFrame:
        other = "b" if own == "a" else "a"
        ids = pairs.select(F.col("trace_id" if own == "a" else "b_trace_id").alias("trace_id"), F.col(f"{own}_signal_id").alias("signal_id"),
                           F.col("trace_id").alias("of"), F.col("a_signal_id").alias("pair"), F.col(f"{own}_end").alias("own_end"))
        kept = spread_join(rows, ids, SIGNAL_KEY, "cycle", bits=bits, dense=crowded.get(own)).where("cycle < own_end").select(
            F.col("of").alias("trace_id"), "pair", "cycle", "raw_bits", "state")
        ended = pairs.where(F.col(f"{own}_end") < F.col("hi")).select(
            "trace_id", F.col("a_signal_id").alias("pair"), F.col(f"{own}_end").alias("cycle"),
            F.lit(0).cast("bigint").alias("raw_bits"), state(ABSENT).alias("state"))
        named = kept.unionByName(ended).withColumnsRenamed({"raw_bits": f"{own}_bits", "state": f"{own}_state"})
        return named.withColumns({f"{other}_bits": F.lit(None).cast("bigint"),
                                  f"{other}_state": F.lit(None).cast("tinyint")})

    columns = ["a_bits", "a_state", "b_bits", "b_state"]
    # A cycle has at most one row of each side.
    seen = scan(side(a, "a").unionByName(side(b, "b")), ["trace_id", "pair"], "cycle", [held(c, f"held_{c}") for c in columns],
                spans, fold=[F.max(c).alias(c) for c in columns], dense=split)

    zero, absent = F.lit(0).cast("bigint"), state(ABSENT)

    def differ(*names: tuple[str, ...]) -> Column:
        bits_a, state_a, bits_b, state_b = (
            F.coalesce(*ns, zero if ns[0].endswith("bits") else absent) for ns in names)
        return ~same(bits_a, state_a, bits_b, state_b)

    now = differ(*[(c, f"held_{c}") for c in columns])
    before = differ(*[(f"held_{c}",) for c in columns])
    # The intervals between rows tile time, so merged regions are the runs of "differs": they begin
    # and end where it flips, and what it was before a row is known from the held values.
    flips = seen.withColumns({"now": now, "before": before}).where("now <> before").select("trace_id", "pair", "cycle", "now")
    flips, key = cut(flips), ["trace_id", "pair"]
    many = cut(dense_keys(flips, key, bits)) if spans else None
    runs = scan(flips, key, "cycle", [next_("cycle", "until")], spans, dense=many).where("now")
    regions = spread_join(runs, pairs.select("trace_id", F.col("a_signal_id").alias("pair"), "path", "lo", "hi"), key, "cycle",
                          bits=bits, dense=many)
    clipped = regions.select("trace_id", "path", F.greatest("cycle", "lo").alias("start"),
                             F.least(F.coalesce("until", "hi"), "hi").alias("end")).where("end > start")
    return clipped.unionByName(mismatched)


def diff_summary(regions: DataFrame) -> DataFrame:
    """Per trace and path: number of regions, differing cycles, first and last differing cycle."""
    return regions.groupBy("trace_id", "path").agg(
        F.count("*").alias("regions"), F.sum(F.col("end") - F.col("start")).cast("bigint").alias("differing_cycles"),
        F.min("start").alias("first_cycle"), F.max("end").alias("last_cycle"))


def compared_signals(signals_a: DataFrame, signals_b: DataFrame, regions: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Signals of the combined traces: two per differing path, with adjacent ids in left signal order."""
    common = common_signals(signals_a, signals_b, traces)
    kept = common.join(regions.select("trace_id", "path").distinct(), ["trace_id", "path"], "left_semi")
    ranked = dense_number(kept, ["trace_id", "a_signal_id"], "place")
    first = ranked.groupBy("trace_id").agg(F.min("place").alias("first"))
    ranked = ranked.join(first, "trace_id").withColumn("rank", F.col("place") - F.col("first") + 1)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), side_path(F.col("path"), s.upper()).alias("side_path"),
                               F.col("trace_id" if s == "a" else "b_trace_id").alias("source_trace"),
                               F.col(f"{s}_signal_id").alias("source_id"), F.col(f"{s}_kind").alias("kind"),
                               F.col(f"{s}_width").alias("width"),
                               (2 * F.col("rank") - (1 if s == "a" else 0)).alias("signal_id"))
                      for s in ("a", "b")])
    return ranked.select("trace_id", "path", F.inline(sides))


def compared_trace(a: DataFrame, b: DataFrame, compared: DataFrame) -> DataFrame:
    """Transitions of the combined traces."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        own = compared.where(F.col("side") == name).select(
            F.col("source_trace").alias("trace_id"), F.col("source_id").alias("signal_id"), F.col("trace_id").alias("of"),
            F.col("signal_id").alias("new_id"), "side_path")
        return spread_join(rows, own, SIGNAL_KEY, "cycle").select(
            F.col("of").alias("trace_id"), F.col("new_id").alias("signal_id"), F.col("side_path").alias("path"), "cycle", "raw_bits", "state")

    return side(a, "a").unionByName(side(b, "b"))


def compared_meta(meta_a: DataFrame, meta_b: DataFrame, signals_a: DataFrame, signals_b: DataFrame,
                  regions: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Headers of the combined traces, with a status instead of an error when there is nothing in one."""
    head_a = meta_a.select("trace_id", F.col("title").alias("ta"), F.col("timescale").alias("sa"))
    head_b = meta_b.select(F.col("trace_id").alias("b_trace_id"), F.col("title").alias("tb"), F.col("timescale").alias("sb"))
    found = common_signals(signals_a, signals_b, traces).groupBy("trace_id").agg(F.count("*").alias("common_paths"))
    differing = regions.select("trace_id", "path").distinct().groupBy("trace_id").agg(F.count("*").alias("differing_paths"))
    row = (_pairs(meta_a, meta_b, traces).join(head_a, "trace_id").join(head_b, "b_trace_id")
           .join(found, "trace_id", "left").join(differing, "trace_id", "left").fillna(0, ["common_paths", "differing_paths"]))
    return row.select(
        "trace_id", F.concat(F.lit("Compare_"), "ta", F.lit("_vs_"), "tb").alias("title"),
        F.when(F.col("sa") == F.col("sb"), F.col("sa")).otherwise("cycle").alias("timescale"),
        F.col("lo").alias("start"), F.col("hi").alias("end"), "common_paths", "differing_paths",
        F.when(F.col("common_paths") == 0, "no_common_path")
        .when(F.col("differing_paths") == 0, "no_difference").otherwise("ok").alias("status"))
