"""Joins and scans that never move rows by a hot key alone."""

import re

from pyspark.sql import functions as F

from stepfold.operators import changes, joins, search
from stepfold.operators.blocks import dense_keys, peak, scan, spread_join
from stepfold.plans.lineage import cut
from tests.test_sources import plan_of


def rows_of(spark):
    return spark.range(4000).select(F.lit("t").alias("trace_id"), (F.col("id") % 3).alias("signal_id"), (F.col("id") * 100).alias("cycle"))


def test_spread_join_equals_a_plain_join(spark):
    rows = rows_of(spark)
    lookup = spark.createDataFrame([("t", 0, "a"), ("t", 0, "b"), ("t", 2, "c"), ("u", 1, "d")], "trace_id string, signal_id bigint, v string")
    key = ["trace_id", "signal_id"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = spread_join(rows, lookup, key, "cycle", how, bits=12)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(lookup, key, how).collect()), key=str)


def test_rows_move_by_key_and_block(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spread_join(rows_of(spark), spark.createDataFrame([("t", 5)], "trace_id string, x int"), ["trace_id"], "cycle")
        text = plan_of(joined)
        keys = set(re.findall(r"SortMergeJoin \[([^\]]*)\]", text))
        assert any("__part" in k for k in keys) and "__salt" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_peak_over_blocks(spark):
    rows = [("t", i, (i * 7919) % 1000) for i in range(300)]
    df = spark.createDataFrame(rows, "trace_id string, seq bigint, v bigint")
    got = {r.seq: r.top for r in scan(df, ["trace_id"], "seq", [peak("v", "top")], (3, 2)).collect()}
    assert got == {i: max((v for _, j, v in rows if j < i), default=None) for i in range(300)}


def test_overlaps_of_long_and_open_intervals(spark):
    end = (1 << 63) - 1
    regions = [(1, 0, end), (2, 5, 6), (3, -70_000, 70_000), (4, 1 << 40, (1 << 40) + 10), (5, 65_536, 1 << 21), (6, 9, 9)]
    windows = [(0, 10), (100_000, end), (-5, 1 << 41), ((1 << 40) + 5, (1 << 40) + 6), (65_535, 65_537), (7, 7)]
    r = spark.createDataFrame([("t", *x) for x in regions], "trace_id string, n int, start bigint, end bigint")
    w = spark.createDataFrame([("t", *x) for x in windows], "trace_id string, start bigint, end bigint")
    got = sorted((x.n, x.w_start, x.clip_start, x.clip_end) for x in joins.clip_regions(r, w, ["trace_id"]).collect())
    want = sorted((n, c, max(a, c), min(b, d)) for n, a, b in regions for c, d in windows if a < b and c < d and a < d and c < b)
    assert got == want


def crowded(spark):
    """Signals of 200, 3, 45 and 1 cycles, some written several times, and their layout."""
    rows = [("t", s, c, q, (c * 7 + q * s) % 3, int((c + q) % 11 == 0)) for s, n in ((1, 200), (2, 3), (3, 90), (4, 1))
            for c in range(0, n, 1 + s % 2) for q in range(1 + c % 3)]
    layout = [("t", s, f"p{s}", w) for s, w in ((1, 2), (2, 2), (3, 1), (4, 2), (9, 2))]
    return (spark.createDataFrame(rows, "trace_id string, signal_id bigint, cycle bigint, seq bigint, raw_bits bigint, state tinyint"),
            spark.createDataFrame(layout, "trace_id string, signal_id bigint, path string, width int"))


def contents(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_only_dense_keys_are_split(spark):
    samples, layout = crowded(spark)
    assert contents(dense_keys(samples, ["signal_id"], 5)) == ["Row(signal_id=1)", "Row(signal_id=3)"]
    changed = cut(changes.compact_changes(samples, "signal_id", ()))
    for spans in ((2, 2), (5, 3)):
        assert contents(changes.compact_changes(samples, "signal_id", spans)) == contents(changed)
        for text in ("2", "-1"):
            assert contents(search.find_value(changed, layout, text, spans)) == contents(search.find_value(changed, layout, text, ()))


def test_spread_join_of_dense_keys(spark):
    rows = rows_of(spark).unionByName(spark.createDataFrame([("t", 7, 1), ("u", 1, 5)], "trace_id string, signal_id bigint, cycle bigint"))
    lookup = spark.createDataFrame([("t", 0, "a"), ("t", 0, "b"), ("t", 2, "c"), ("u", 1, "d")], "trace_id string, signal_id bigint, v string")
    key = ["trace_id", "signal_id"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = spread_join(rows, lookup, key, "cycle", how, bits=9, dense=dense_keys(rows, key, 9))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(lookup, key, how).collect()), key=str)


def test_thin_signals_move_once(spark):
    """No edges of blocks, and one shuffle of the rows, where no signal has more rows than a block may hold."""
    samples, layout = crowded(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.find_value(cut(changes.compact_changes(samples, "signal_id")), layout, "2")
        found.collect()
        final = final_plan(found)
        assert "__e_was_hit" not in final
        assert len(re.findall(r"Exchange hashpartitioning\(trace_id#\d+, signal_id#\d+L, __cycle_block", final)) == 2  # rows and targets
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_last_writes_of_thin_signals_need_no_aggregate(spark):
    """Missing cycles, orders and values give what the aggregate of a plain scan gives, from the scan's own sort."""
    rows = [("t", 1, None, 1, 5, 0), ("t", 1, None, 2, 6, 0), ("t", 1, 3, None, 7, 0), ("t", 1, 3, None, 8, 1), ("t", 1, 4, None, 1, 0),
            ("t", 1, 4, 1, None, 0), ("t", 1, 9, 5, 2, 0), ("t", 1, 9, 4, 3, 0)] + [("t", 2, i // 3, i, i % 4, 0) for i in range(60)]
    samples = spark.createDataFrame(rows, "trace_id string, signal_id bigint, cycle bigint, seq bigint, raw_bits bigint, state tinyint")
    want = contents(changes.compact_changes(samples, "signal_id", ()))
    for spans in ((2, 2), (17, 16)):
        got = changes.compact_changes(samples, "signal_id", spans)
        assert contents(got) == want
    got.collect()
    assert "max_by" not in final_plan(got)
