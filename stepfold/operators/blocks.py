"""Ordered scans over one signal without putting the signal into one task.

A window partitioned by signal alone is one task per signal, and one signal may hold a third of a
trace. ``scan`` splits each signal into blocks of cycles, runs the window inside the blocks and
carries what crosses a block edge through a table of one row per non-empty block:

    rows    -> window per (keys, block)                   at most ``spans[0]`` rows per group
    edges   -> one row per (keys, block), pre-aggregated  at most ``spans[1]`` rows per group
    top     -> one row per (keys, block of blocks)        trace length / (spans[0] * spans[1])

The bounds hold because ``order`` is unique per key. Rows are shuffled by (keys, block) and sorted
once; the window and the join that brings the carry back both use that partitioning. The edges are
aggregated from the input with a map-side half, so only one row per block and task moves for them.

Where most keys have few rows, their blocks hold a few rows each and edges cost as much as rows. Then
``dense_keys`` names the keys with more rows than a block may hold: only these are split, the others
are one group each. Adaptive execution leaves the edges out where no key is dense.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# log2 of cycles per block, then of blocks per block of blocks.
SPANS = (17, 16)


@dataclass(frozen=True)
class Carry:
    """One output of a scan: ``kind`` of the column ``value`` seen from each row, named ``out``."""

    kind: str
    value: str
    out: str

    def local(self, keys: list[str], order: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(order)
        if self.kind == "prev":
            return F.lag(self.value).over(w)
        if self.kind == "next":
            return F.lead(self.value).over(w)
        earlier = (Window.unboundedPreceding, -1)
        if self.kind == "held":
            return F.last(self.value, ignorenulls=True).over(w.rowsBetween(*earlier))
        if self.kind == "ahead":
            # A descending window keeps the running form; "following" frames are quadratic.
            back = Window.partitionBy(*keys).orderBy(F.col(order).desc())
            return F.last(self.value, ignorenulls=True).over(back.rowsBetween(*earlier))
        if self.kind == "peak":
            return F.max(self.value).over(w.rowsBetween(*earlier))
        return F.coalesce(F.sum(self.value).over(w.rowsBetween(*earlier)), F.lit(0))

    def edge(self, order: str) -> Column:
        at = F.when(F.col(self.value).isNotNull(), F.col(order))
        if self.kind in ("prev", "held"):
            return F.max_by(self.value, at)
        if self.kind in ("next", "ahead"):
            return F.min_by(self.value, at)
        return F.max(self.value) if self.kind == "peak" else F.sum(self.value)

    def merge(self, carried: Column) -> Column:
        if self.kind == "total":
            return F.col(self.out) + F.coalesce(carried, F.lit(0))
        if self.kind == "peak":
            return F.greatest(self.out, carried)
        return F.coalesce(F.col(self.out), carried)


def prev(value: str, out: str) -> Carry:
    """Value of the row before. ``value`` is never null."""
    return Carry("prev", value, out)


def next_(value: str, out: str) -> Carry:
    """Value of the row after. ``value`` is never null."""
    return Carry("next", value, out)


def held(value: str, out: str) -> Carry:
    """Last non-null value strictly before the row."""
    return Carry("held", value, out)


def ahead(value: str, out: str) -> Carry:
    """First non-null value strictly after the row."""
    return Carry("ahead", value, out)


def total(value: str, out: str) -> Carry:
    """Sum of ``value`` over the rows before."""
    return Carry("total", value, out)


def peak(value: str, out: str) -> Carry:
    """Greatest ``value`` of the rows before."""
    return Carry("peak", value, out)


def _present(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in keys])


def _block_name(order: str) -> str:
    return f"__{order.strip('_')}_block"


def _block(order: str, bits: int) -> Column:
    return F.coalesce(F.shiftright(F.col(order).cast("bigint"), bits), F.lit(0).cast("bigint"))


def dense_keys(rows: DataFrame, keys: Sequence[str], bits: int = SPANS[0]) -> DataFrame:
    """Keys with more than ``2^bits`` rows: at most one for so many rows, so the table may be broadcast."""
    counted = rows.where(_present(keys)).groupBy(*keys).agg(F.count("*").alias("__rows"))
    return counted.where(F.col("__rows") > (1 << bits)).select(*keys)


def place(rows: DataFrame, keys: Sequence[str], order: str, dense: DataFrame, bits: int) -> tuple[DataFrame, str]:
    """The rows with their block, of ``order`` where the key is dense, else 0, and that column's name."""
    marked = rows.join(F.broadcast(dense.withColumn("__dense", F.lit(True))), list(keys), "left")
    block = F.when(F.col("__dense"), _block(order, bits)).otherwise(F.lit(0).cast("bigint"))
    return marked.withColumn(_block_name(order), block).drop("__dense"), _block_name(order)


def scan(df: DataFrame, keys: Sequence[str], order: str, carries: Sequence[Carry],
         spans: Sequence[int] = SPANS, fold: Sequence[Column] | None = None, dense: DataFrame | None = None) -> DataFrame:
    """Add the ``carries`` to ``df``; ``(keys, order)`` must be unique and ``order`` a BIGINT.

    ``fold`` makes them unique: aggregates, aliased, for the rows of one (keys, order). They run in
    the block's own partition, after the only shuffle of the rows, and are meant for inputs with a
    small known number of rows per (keys, order); where that number has no bound, aggregate first.

    With ``dense`` (see ``dense_keys``, with ``spans[0]``) only these keys are split into blocks. Rows
    that ``spread_join`` has placed by the same table stay where they are.
    """
    keys = list(keys)
    block = _block_name(order)
    if not spans:
        folded = df if fold is None else df.groupBy(*keys, order).agg(*fold)
        return folded.withColumns({c.out: c.local(keys, order) for c in carries}).drop(block)
    # The optimizer adds "key is not null" to the edges, whose keys are join keys. Stated here, and
    # with a block that cannot be null, both uses of the rows have the same plan and share shuffles.
    blocked = df.where(_present(keys))
    if dense is None:
        blocked = blocked.withColumn(block, _block(order, spans[0]))
    elif block not in df.columns:
        blocked, _ = place(blocked, keys, order, dense, spans[0])
    if fold is not None:
        blocked = blocked.repartition(*keys, block).groupBy(*keys, block, order).agg(*fold)
    inner = blocked.withColumns({c.out: c.local([*keys, block], order) for c in carries})
    split = blocked if dense is None else blocked.join(F.broadcast(dense), keys)
    edges = split.groupBy(*keys, block).agg(*[c.edge(order).alias(f"__e_{c.out}") for c in carries])
    above = scan(edges, keys, block, [Carry(c.kind, f"__e_{c.out}", f"__c_{c.out}") for c in carries],
                 spans[1:])
    above = above.select(*keys, block, *[f"__c_{c.out}" for c in carries])
    joined = inner.join(above, [*keys, block], "left")
    return (joined.withColumns({c.out: c.merge(F.col(f"__c_{c.out}")) for c in carries})
            .drop(block, *[f"__c_{c.out}" for c in carries]))


def spread_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], spread_by: str, how: str = "inner",
                bits: int = SPANS[0], dense: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Join many rows to a lookup when one key may hold a large share of the rows.

    The distinct (key, block of ``spread_by``) pairs of the rows, found with a map-side half, take what the
    lookup has for their key; the rows then meet them by (key, block). So rows never move by the key
    alone, and the lookup is repeated only for blocks that exist. ``how``: inner, left, left_semi, left_anti.

    With ``dense`` (see ``dense_keys``, with ``bits``) only these keys are spread; ``keep`` leaves the rows'
    block in place for a ``scan`` along ``spread_by`` with the same keys.
    """
    on = list(on)
    if dense is not None:
        few = F.broadcast(dense)
        named = lookup.select(*on) if how in ("left_semi", "left_anti") else lookup
        blocked, block = place(rows, on, spread_by, dense, bits)
        crowded = blocked.join(few, on).select(*on, block).distinct().join(named, on)
        placed = named.join(few, on, "left_anti").withColumn(block, F.lit(0).cast("bigint")).unionByName(crowded)
        joined = blocked.join(placed, [*on, block], how)
        return joined if keep else joined.drop(block)
    blocked = rows.withColumn("__part", _block(spread_by, bits))
    pairs = blocked.select(*on, "__part").distinct()
    if how in ("left_semi", "left_anti"):
        placed = pairs.join(lookup.select(*on), on, "left_semi")
    else:
        placed = pairs.join(lookup, on)
    return blocked.join(placed, [*on, "__part"], how).drop("__part")
