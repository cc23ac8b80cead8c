"""The hierarchy of names: paths, search, visibility, leaf distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions.names import with_range
from stepfold.operators.blocks import spread_join
from stepfold.operators.joins import first_per
from stepfold.operators.numbering import dense_number
from stepfold.plans.lineage import cut

# log2 of the node ids that a hot ancestor's rows are split by.
NODE_BITS = 12


def _glue(head: Column, tail: Column) -> Column:
    """Join two paths; an index segment follows without a dot, empty segments add nothing."""
    return (F.when(F.length(head) == 0, tail).when(F.length(tail) == 0, head)
            .when(F.startswith(tail, F.lit("[")), F.concat(head, tail))
            .otherwise(F.concat(head, F.lit("."), tail)))


def node_paths(nodes: DataFrame) -> DataFrame:
    """Path, depth, ancestors (root first) and sibling order key of every node that reaches a root.

    Each node starts with a pointer to its parent; every round appends the pointed-to node's chain
    and takes over its pointer, so chains double and a tree of depth d is done in log2(d) joins
    rather than d. Each round writes the nodes that were open; finished ones stay where they are. The
    loop ends when no node is open. Orphans and nodes on or below a cycle leave it without a path;
    the checks report them.
    """
    chains = nodes.select(
        "trace_id", "node_id", "parent_id", "ordinal", "name", "node_kind",
        F.coalesce("parent_id", F.lit(0)).alias("pointer"), F.coalesce("name", F.lit("")).alias("path"),
        F.array().cast("array<bigint>").alias("ancestors"),
        F.array(F.col("ordinal").cast("bigint")).alias("order_key"))
    done, open_ = chains.where("pointer = 0"), chains.where("pointer <> 0")
    while not open_.isEmpty():
        chains = done.unionByName(open_)
        # Only nodes with children are looked up: a small part of a tree, mostly made of leaves.
        parents = open_.select("trace_id", F.col("pointer").alias("node_id")).distinct()
        targets = chains.join(parents, ["trace_id", "node_id"], "left_semi").select(
            "trace_id", F.col("node_id").alias("pointer"), F.col("pointer").alias("t_pointer"),
            F.col("path").alias("t_path"), F.col("ancestors").alias("t_ancestors"),
            F.col("order_key").alias("t_order"))
        moved = spread_join(open_, targets, ["trace_id", "pointer"], "node_id", bits=NODE_BITS).select(
            "trace_id", "node_id", "parent_id", "ordinal", "name", "node_kind", F.col("t_pointer").alias("pointer"),
            _glue(F.col("t_path"), F.col("path")).alias("path"),
            F.concat("t_ancestors", F.array("pointer"), "ancestors").alias("ancestors"),
            F.concat("t_order", "order_key").alias("order_key"))
        # Orphans have no target and drop out of the join. A node whose chain meets itself is on a
        # cycle and leaves here; what hangs below it becomes an orphan.
        looped = F.array_contains("ancestors", F.col("pointer")) | (F.col("pointer") == F.col("node_id"))
        moved = cut(moved.where(~looped))
        done, open_ = done.unionByName(moved.where("pointer = 0")), moved.where("pointer <> 0")
    return done.select(
        "trace_id", "node_id", "parent_id", "ordinal", "name", "node_kind", "path",
        F.size("ancestors").alias("depth"), "ancestors", "order_key")


def tree_from_names(signals: DataFrame) -> DataFrame:
    """Nodes from dotted names: shared prefixes merge, empty segments are skipped, leaves hold signals.

    Ids are consecutive in path order. Of signals with equal paths the last one keeps the leaf.
    """
    segments = F.filter(F.split("path", "\\."), lambda s: F.length(s) > 0)
    named = signals.select("trace_id", "signal_id", "width", segments.alias("segments")).where(F.size("segments") > 0)
    leaves = named.select("trace_id", F.concat_ws(".", "segments").alias("path"), "signal_id", "width")
    prefixes = named.select("trace_id", "segments", F.explode(F.sequence(F.lit(1), F.size("segments"))).alias("depth"))
    nodes = prefixes.select(
        "trace_id", F.concat_ws(".", F.slice("segments", F.lit(1), F.col("depth"))).alias("path"),
        F.concat_ws(".", F.slice("segments", F.lit(1), F.col("depth") - 1)).alias("parent_path"),
        F.element_at("segments", F.col("depth")).alias("name"), F.col("depth") - 1).distinct().toDF(
        "trace_id", "path", "parent_path", "name", "depth")
    numbered = dense_number(nodes, ["trace_id", "path"], "node_id")
    parents = numbered.select("trace_id", F.col("path").alias("parent_path"), F.col("node_id").alias("parent_id"))
    held = leaves.groupBy("trace_id", "path").agg(
        F.max("signal_id").alias("signal_id"), F.max_by("width", "signal_id").alias("width"))
    return (numbered.join(parents, ["trace_id", "parent_path"], "left").join(held, ["trace_id", "path"], "left")
            .select("trace_id", "node_id", F.coalesce("parent_id", F.lit(0).cast("bigint")).alias("parent_id"),
                    "name", "path", F.col("depth").cast("int").alias("depth"), "signal_id", "width"))


def search_segments(query: str) -> list[str]:
    """Segments of one search text; blanks around them and empty ones do not count."""
    return [s.strip() for s in query.split(".") if s.strip()]


def _equals(segment: str) -> Column:
    """Node name equals the segment, bare or with its range, also without a comparison prefix."""
    want = segment.lower()
    bare, shown = F.lower("name"), F.lower(F.col("shown"))
    sided = F.col("name").rlike("^[AB] .") & (
        (F.substr(bare, F.lit(3)) == want) | (F.substr(shown, F.lit(3)) == want))
    return (bare == want) | (shown == want) | sided


def search_nodes(nodes: DataFrame, query: str, all_ends: bool = False) -> DataFrame:
    """Nodes a search text leads to, in order of the node it starts from.

    One segment is a case-insensitive part of a name. Several are a chain of direct children that
    may start anywhere; the end of the chain is returned, the first one per start unless
    ``all_ends``. ``nodes`` has name, parent_id, ordinal and, for signals, signal_id and width.
    """
    parts = search_segments(query)
    # Only signals show a range.
    shown = F.when(F.col("signal_id").isNotNull(), with_range(F.col("name"), F.coalesce("width", F.lit(1))))
    named = nodes.select("trace_id", "node_id", "parent_id", "ordinal", "name",
                         F.coalesce(shown, F.col("name")).alias("shown"))
    if not parts:
        return named.where(F.lit(False)).select("trace_id", F.col("node_id").alias("start_id"), "node_id")
    if len(parts) == 1:
        found = named.where(F.contains(F.lower("shown"), F.lit(parts[0].lower()))).select(
            "trace_id", F.col("node_id").alias("start_id"), "node_id")
    else:
        chain = named.where(_equals(parts[0])).select(
            "trace_id", F.col("node_id").alias("start_id"), "node_id", F.array().cast("array<int>").alias("way"))
        for part in parts[1:]:
            child = named.where(_equals(part)).select("trace_id", F.col("parent_id").alias("node_id"),
                                                      F.col("node_id").alias("child_id"), "ordinal")
            chain = chain.join(child, ["trace_id", "node_id"]).select(
                "trace_id", "start_id", F.col("child_id").alias("node_id"), F.concat("way", F.array("ordinal")).alias("way"))
        if all_ends:
            found = chain.select("trace_id", "start_id", "node_id")
        else:
            found = chain.groupBy("trace_id", "start_id").agg(
                F.min(F.struct("way", "node_id")).alias("first")).select("trace_id", "start_id", "first.node_id")
    return found.orderBy("trace_id", "start_id", "node_id")


def search_visibility(paths: DataFrame, matches: DataFrame) -> DataFrame:
    """Nodes shown for a search: matches, all their ancestors, and the subtrees of matched modules.

    ``paths`` is ``node_paths`` with a nullable ``signal_id``.
    """
    key = ["trace_id", "node_id"]
    hit = paths.join(matches.select(*key).distinct(), key, "left_semi")
    up = hit.select("trace_id", F.explode(F.concat("ancestors", F.array("node_id"))).alias("node_id"))
    modules = hit.where(F.col("signal_id").isNull()).select("trace_id", F.col("node_id").alias("ancestor"))
    below = paths.select(*key, F.explode("ancestors").alias("ancestor"))
    down = spread_join(below, modules, ["trace_id", "ancestor"], "node_id", "left_semi", NODE_BITS).select(*key)
    return up.unionByName(down).distinct()


def signals_under(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct signals in the subtrees of the given nodes, in tree order."""
    within = paths.where(F.col("signal_id").isNotNull()).select(
        "trace_id", "signal_id", "path", "order_key",
        F.explode(F.concat("ancestors", F.array("node_id"))).alias("root"))
    picked = spread_join(within, roots.select("trace_id", F.col("node_id").alias("root")), ["trace_id", "root"],
                         "signal_id", "left_semi", NODE_BITS)
    # A signal under two picked nodes is kept once; its order key is the same in both rows.
    once = picked.groupBy("trace_id", "signal_id").agg(F.min("path").alias("path"), F.min("order_key").alias("order_key"))
    return once.orderBy("trace_id", "order_key").select("trace_id", "signal_id", "path")


def leaf_distribution(paths: DataFrame, leaves: DataFrame, top_n: int | None = 50) -> DataFrame:
    """Per depth the ``top_n`` nodes with most leaves below them (a leaf counts for itself too), or all.

    ``leaves`` has (trace_id, node_id), one row per leaf signal.
    """
    counted = leaves.groupBy("trace_id", "node_id").agg(F.count("*").alias("n"))
    closure = paths.join(counted, ["trace_id", "node_id"]).select(
        "trace_id", "n", F.explode(F.concat("ancestors", F.array("node_id"))).alias("node_id"))
    # The root's key is in every row, but the map-side half leaves one row of it per task.
    counts = closure.groupBy("trace_id", "node_id").agg(F.sum("n").cast("bigint").alias("leaf_count"))
    shown = counts.join(paths.select("trace_id", "node_id", "depth", "path"), ["trace_id", "node_id"])
    if top_n is None:
        return shown
    return first_per(shown, ["trace_id", "depth"], [F.col("leaf_count").desc(), F.col("node_id")], top_n)


def leaf_totals(paths: DataFrame, leaves: DataFrame) -> DataFrame:
    """Leaves under the roots, nodes with at least one leaf, and the greatest depth of those."""
    counted = leaves.groupBy("trace_id", "node_id").agg(F.count("*").alias("n"))
    held = paths.join(counted, ["trace_id", "node_id"])
    active = held.select("trace_id", F.explode(F.concat("ancestors", F.array("node_id"))).alias("node_id"))
    nodes = active.distinct().groupBy("trace_id").agg(F.count("*").alias("active_nodes"))
    return held.groupBy("trace_id").agg(
        F.sum("n").cast("bigint").alias("leaves_at_roots"), F.max("depth").alias("max_depth")).join(nodes, "trace_id")


__all__ = ["node_paths", "tree_from_names", "search_nodes", "search_visibility", "signals_under",
           "leaf_distribution", "leaf_totals", "search_segments"]
