"""Data-quality reports: one row per violation, instead of refusing the whole trace."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions.bits import mask_of
from stepfold.operators.blocks import SPANS, peak, scan, spread_join
from stepfold.operators.tree import node_paths
from stepfold.schema import KNOWN, TYPE_BITS

# Node kinds and radices a layout may name.
NODE_KINDS = ["Root", "Object", "Field", "ArrayElem", "Container", "SignalLeaf"]
RADICES = ["auto", "bin", "dec", "hex", "float"]
MAX_CYCLE = (1 << 63) - 1


def type_bits(value_type: Column) -> Column:
    pairs = [x for name, bits in TYPE_BITS.items() for x in (F.lit(name), F.lit(bits))]
    return F.element_at(F.create_map(*pairs), value_type)


def _report(rows: DataFrame, kind: str, subject: str, rules: dict[str, Column]) -> DataFrame:
    """All row-local rules in one pass over the rows."""
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return rows.select("trace_id", F.lit(kind).alias("subject_kind"), F.col(subject).cast("bigint").alias("subject_id"),
                       F.explode(broken).alias("rule"))


def _rule(rows: DataFrame, kind: str, subject: str, rule: str) -> DataFrame:
    return rows.select("trace_id", F.lit(kind).alias("subject_kind"), F.col(subject).cast("bigint").alias("subject_id"),
                       F.lit(rule).alias("rule"))


def _duplicates(rows: DataFrame, kind: str, subject: str, rule: str) -> DataFrame:
    many = rows.groupBy("trace_id", subject).agg(F.count("*").alias("n")).where("n > 1")
    return _rule(many, kind, subject, rule)


def check_topology(nodes: DataFrame, signals: DataFrame, clocks: DataFrame) -> DataFrame:
    """Violations of the layout rules by nodes, signals and clocks."""
    node_key = nodes.select("trace_id", "node_id").distinct()
    parents = nodes.where("parent_id <> 0").select("trace_id", F.col("parent_id").alias("node_id")).distinct()
    child = nodes.where("parent_id <> 0")
    lost = child.join(node_key.withColumnRenamed("node_id", "parent_id"), ["trace_id", "parent_id"], "left_anti")
    reached = node_paths(nodes).select("trace_id", "node_id").distinct()
    rootless = (nodes.groupBy("trace_id").agg(F.count(F.when(F.col("parent_id") == 0, 1)).alias("roots"))
                .where("roots = 0").withColumn("none", F.lit(0)))
    found = [
        _report(nodes, "node", "node_id", {
            "id_not_positive": F.col("node_id") <= 0,
            "name_empty": F.coalesce(F.length("name"), F.lit(0)) == 0,
            "parent_is_self": F.col("parent_id") == F.col("node_id"),
            "kind_invalid": ~F.coalesce(F.col("node_kind").isin(NODE_KINDS), F.lit(False))}),
        _duplicates(nodes, "node", "node_id", "id_duplicate"),
        _rule(lost, "node", "node_id", "parent_missing"),
        _rule(nodes.join(reached, ["trace_id", "node_id"], "left_anti"), "node", "node_id", "unreachable"),
        _rule(rootless, "trace", "none", "no_root"),
    ]

    visible = signals.where(~F.coalesce("storage_only", F.lit(False)))
    on_node = visible.join(node_key, ["trace_id", "node_id"], "left_anti")
    on_parent = visible.join(parents, ["trace_id", "node_id"], "left_semi")
    leaf_nodes = nodes.where("node_kind = 'SignalLeaf'").select("trace_id", "node_id").distinct()
    not_leaf = visible.join(node_key, ["trace_id", "node_id"], "left_semi").join(
        leaf_nodes, ["trace_id", "node_id"], "left_anti")
    width, offset, bits = F.col("width"), F.coalesce("bit_offset", F.lit(0)), type_bits(F.col("value_type"))
    # The first signal on a storage stream fixes how many bits the stream has.
    owners = signals.groupBy("trace_id", "storage_id").agg(
        F.min("signal_id").alias("owner"), F.min_by("value_type", "signal_id").alias("owner_type"),
        F.min_by("bit_offset", "signal_id").alias("owner_offset"))
    owned = signals.join(owners, ["trace_id", "storage_id"], "left")
    only = F.coalesce("storage_only", F.lit(False))
    found += [
        _report(signals, "signal", "signal_id", {
            "id_not_positive": F.col("signal_id") <= 0,
            "width_out_of_range": (width < 1) | (width > 64),
            "type_invalid": bits.isNull(),
            "width_exceeds_type": width > bits,
            "bit_range_invalid": (offset < 0) | (offset >= 64) | (offset + width > 64),
            "radix_invalid": ~F.coalesce(F.col("radix").isin(RADICES), F.lit(False)),
            "storage_only_with_node": only & (F.coalesce("node_id", F.lit(0)) != 0),
            "storage_only_not_own_storage": only & (F.col("storage_id") != F.col("signal_id")),
            "storage_only_with_offset": only & (offset != 0)}),
        _duplicates(signals, "signal", "signal_id", "id_duplicate"),
        _rule(on_node, "signal", "signal_id", "node_missing"),
        _rule(on_parent, "signal", "signal_id", "node_has_children"),
        _rule(not_leaf, "signal", "signal_id", "node_not_leaf_kind"),
        _rule(owned.where((F.col("signal_id") != F.col("owner"))
                          & (F.coalesce("bit_offset", F.lit(0)) + width > type_bits(F.col("owner_type")))),
              "signal", "signal_id", "bit_range_beyond_storage"),
        _rule(owners.where(F.coalesce("owner_offset", F.lit(0)) != 0), "signal", "owner", "first_on_storage_has_offset"),
    ]

    clocked = clocks.join(signals.select("trace_id", "signal_id", "value_type", "width").distinct(),
                          ["trace_id", "signal_id"], "left")
    found += [
        _report(clocked, "clock", "signal_id", {
            "signal_missing": F.col("value_type").isNull(),
            "not_one_bit_bool": F.col("value_type").isNotNull() & ((F.col("value_type") != "Bool") | (width != 1)),
            "period_not_positive": F.col("period_ticks") <= 0}),
        _duplicates(clocks, "clock", "signal_id", "id_duplicate"),
    ]
    return reduce(DataFrame.unionByName, found)


def known_storages(signals: DataFrame, clocks: DataFrame) -> DataFrame:
    """Storage streams with the width of their type and whether a clock generates them."""
    streams = signals.groupBy("trace_id", "storage_id").agg(
        F.min_by("value_type", "signal_id").alias("value_type"),
        F.min_by("width", "signal_id").alias("stream_width"))
    generated = clocks.select("trace_id", F.col("signal_id").alias("storage_id"), F.lit(True).alias("is_clock")).distinct()
    return streams.join(generated, ["trace_id", "storage_id"], "left").select(
        "trace_id", "storage_id", "value_type", "stream_width", F.coalesce("is_clock", F.lit(False)).alias("is_clock"))


def update_rules(byte_count: bool = False) -> dict[str, Column]:
    """Row-local rules for one update joined to ``known_storages`` (shared with the stream guard)."""
    bits = F.col("raw_bits")
    defined = F.col("value_type").isNotNull()
    full = mask_of(type_bits(F.col("value_type")))
    # A signed value may carry its sign above its width; what must be clear is above the type.
    fits = bits.bitwiseAND(full) == bits
    signed = F.col("value_type").isin("I8", "I16", "I32", "I64")
    low = F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.least(type_bits(F.col("value_type")), F.lit(64)) - 1))
    sign_ok = signed & (bits >= low) & (bits < 0)
    rules = {
        "cycle_negative": F.col("cycle") < 0,
        "cycle_too_large": F.col("cycle") >= MAX_CYCLE,
        "signal_undefined": ~defined,
        "signal_is_clock": defined & F.col("is_clock"),
        "state_not_known": F.col("state") != KNOWN,
        "value_too_wide": defined & (F.col("state") == KNOWN) & ~(fits | sign_ok),
    }
    if byte_count:
        rules["byte_width_mismatch"] = defined & (F.col("byte_count") * 8 != type_bits(F.col("value_type")))
    return rules


def check_updates(samples: DataFrame, signals: DataFrame, clocks: DataFrame) -> DataFrame:
    """Violations by updates: (trace_id, storage_id, cycle, seq, rule).

    ``seq`` is the order of submission. A cycle submitted after a later one, and a signal that
    appears twice in a cycle, are found by aggregates and one running maximum over submissions.
    """
    keyed = spread_join(samples, known_storages(signals, clocks), ["trace_id", "storage_id"], "cycle", how="left")
    rules = update_rules("byte_count" in samples.columns)
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    local = keyed.select("trace_id", "storage_id", "cycle", "seq", F.explode(broken).alias("rule"))
    twice = samples.groupBy("trace_id", "storage_id", "cycle").agg(
        F.count("*").alias("n"), F.max("seq").alias("seq")).where("n > 1")
    return local.unionByName(twice.select("trace_id", "storage_id", "cycle", "seq", F.lit("duplicate_in_cycle").alias("rule")))


def check_submission_order(samples: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """Submissions (one per cycle) whose cycle is not above every cycle submitted before.

    The running maximum over submissions is kept by blocks of ``seq`` and blocks of blocks, so
    neither the rows nor the blocks of a trace are in one task.
    """
    order = samples.groupBy("trace_id", "seq").agg(F.min("cycle").alias("cycle"))
    return scan(order, ["trace_id"], "seq", [peak("cycle", "top")], spans).where("cycle < top").select(
        "trace_id", "seq", "cycle", F.lit("cycle_not_increasing").alias("rule"))
