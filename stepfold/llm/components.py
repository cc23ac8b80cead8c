"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.tables import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable from each node of ``edges`` (a, b).

    Alternates large stars (a node's larger neighbours move to its smallest one) and small stars (its smaller ones do), until every
    edge points at its component's smallest node. Edges never grow in number, hot nodes only meet in minima that are
    summed before rows move, and each round is a table in the shared folder. Loops and repeated edges are ignored.
    """
    stars = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(stars)
    while before[0]:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        stars = settle(small.filter("a <> b").distinct())
        after = _mark(stars)
        if after == before:
            break
        before = after
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Two numbers that change when the edges do."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)
