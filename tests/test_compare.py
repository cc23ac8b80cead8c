"""Comparing traces, against the question asked at every cycle."""

import random

import pytest

from stepfold.operators import changes, compare, search
from stepfold.plans.lineage import cut
from stepfold.schema import TRANSITIONS
from tests import models

META = "trace_id string, title string, timescale string, start bigint, end bigint"
SIGNAL = "trace_id string, signal_id bigint, path string, kind string, width int"


def run(spark, a, b, start, a_end, b_end, spans, signals_a=None, signals_b=None):
    def tables(signals):
        return spark.createDataFrame([("t", *x) for x in signals], SIGNAL)

    layout = [(s, f"top.s{s}", "bus", 2) for s in range(1, 5)]
    return compare.diff_traces(
        models.events_table(spark, a), tables(signals_a or layout),
        spark.createDataFrame([("t", "a", "1ns", start, a_end)], META),
        models.events_table(spark, b), tables(signals_b or layout),
        spark.createDataFrame([("t", "b", "1ns", start, b_end)], META), spans)


def regions(df):
    return sorted((r.path, r.start, r.end) for r in df.collect())


def answer(a, b, start, a_end, b_end):
    out = []
    for s in range(1, 5):
        flags = []
        for c in range(start, max(a_end, b_end)):
            left = models.value(a.get(s, {}), c) if c < a_end else models.ABSENT
            right = models.value(b.get(s, {}), c) if c < b_end else models.ABSENT
            flags.append(left != right)
        out += [(f"top.s{s}", *r) for r in models.runs(flags, start)]
    return sorted(out)


@pytest.mark.parametrize("seed,start,a_end,b_end,spans", [
    (1, 0, 50, 50, (17, 16)), (2, 0, 50, 35, (2, 2)), (3, 10, 30, 50, (3,)), (4, 7, 50, 44, ())])
def test_regions(spark, seed, start, a_end, b_end, spans):
    rng = random.Random(seed)
    a = models.written(models.random_samples(rng, 4, 120, 50))
    b = {s: dict(e) for s, e in a.items()}
    for events in b.values():
        for c in rng.sample(sorted(events), len(events) // 3):
            events[c] = (rng.randrange(3), 0) if rng.random() < 0.7 else (0, 1)
    got = regions(run(spark, a, b, start, a_end, b_end, spans))
    assert got == answer(a, b, start, a_end, b_end)
    assert regions(run(spark, b, a, start, b_end, a_end, spans)) == got
    assert regions(run(spark, a, a, start, a_end, a_end, spans)) == []


def test_width_mismatch_and_duplicate_paths(spark):
    left = [(1, "p", "bus", 2), (2, "p", "bus", 2), (3, "q", "bus", 2), (4, "", "bus", 2)]
    right = [(7, "p", "bus", 3), (8, "q", "bus", 2), (9, "", "bus", 2)]
    events = {3: {0: (1, 0)}, 8: {0: (1, 0), 5: (2, 0)}}
    got = run(spark, {3: events[3]}, {8: events[8]}, 0, 10, 10, (2,), left, right)
    assert regions(got) == [("p", 0, 10), ("q", 5, 10)]


def test_three_traces_per_side(spark):
    """Of three pairs one is equal, one differs in a value, and one ends early; ids of the right side are its own."""
    event, signal = "trace_id string, signal_id bigint, cycle bigint, raw_bits bigint, state tinyint", SIGNAL
    a = [(t, 1, 0, 1, 0) for t in "xyz"] + [("y", 1, 20, 2, 0)]
    b = [(t, 5, 0, 1, 0) for t in "XYZ"] + [("Y", 5, 20, 3, 0)]
    left = spark.createDataFrame([(t, 1, "p", "bus", 2) for t in "xyz"], signal), spark.createDataFrame([(t, t, "1ns", 0, 50) for t in "xyz"], META)
    right = (spark.createDataFrame([(t, 5, "p", "bus", 2) for t in "XYZ"], signal),
             spark.createDataFrame([(t, t, "1ns", 0, 40 if t == "Z" else 50) for t in "XYZ"], META))
    traces = spark.createDataFrame([(t, t.upper()) for t in "xyz"], "trace_id string, b_trace_id string")
    rows = spark.createDataFrame(a, event), spark.createDataFrame(b, event)
    found = compare.diff_traces(rows[0], *left, rows[1], *right, traces=traces)
    assert sorted(tuple(r) for r in found.collect()) == [("y", "p", 20, 50), ("z", "p", 40, 50)]
    signals = compare.compared_signals(left[0], right[0], found, traces)
    assert sorted((r.trace_id, r.source_trace, r.signal_id) for r in signals.collect()) == [("y", "Y", 2), ("y", "y", 1), ("z", "Z", 2), ("z", "z", 1)]
    combined = compare.compared_trace(*rows, signals)
    assert sorted((r.trace_id, r.signal_id, r.cycle, r.raw_bits) for r in combined.collect()) == [
        ("y", 1, 0, 1), ("y", 1, 20, 2), ("y", 2, 0, 1), ("y", 2, 20, 3), ("z", 1, 0, 1), ("z", 2, 0, 1)]
    heads = compare.compared_meta(left[1], right[1], left[0], right[0], found, traces)
    assert sorted((r.trace_id, r.title, r.end, r.status) for r in heads.collect()) == [
        ("x", "Compare_x_vs_X", 50, "no_difference"), ("y", "Compare_y_vs_Y", 50, "ok"), ("z", "Compare_z_vs_Z", 50, "ok")]


def test_comparison_splits_only_dense_pairs(spark):
    """Edges of blocks are left out where all signals are thin; dense, thin and one-sided pairs give the same regions."""
    def run(seed):
        rows = [("t", s, c, (c * seed + s) % 5 % 3, 0) for s, n in ((1, 120), (2, 4), (3, 30 * seed)) for c in range(s, n)]
        return changes.drop_repeats(spark.createDataFrame(rows, TRANSITIONS), spans=())

    signals = spark.createDataFrame([("t", s, f"p{s}", "bus", 2) for s in (1, 2, 3, 4)], "trace_id string, signal_id bigint, path string, kind string, width int")
    meta = spark.createDataFrame([("t", 0, 140)], "trace_id string, start bigint, end bigint")
    a, b = cut(run(1)), cut(run(3))
    want = sorted(map(tuple, compare.diff_traces(a, signals, meta, b, signals, meta, ()).collect()))
    for spans in ((4, 2), (17, 16)):
        assert want == sorted(map(tuple, compare.diff_traces(a, signals, meta, b, signals, meta, spans).collect()))
    found = search.prev_diff(compare.diff_traces(a, signals, meta, b, signals, meta), spark.createDataFrame([("t", 50), ("t", 0)], "trace_id string, cycle bigint"))
    rows = sorted(map(tuple, found.collect()))
    starts = {r[2] for r in want}
    assert rows == sorted(("t", c, max(x for x in starts if x <= c)) for c in (0, 50) if any(x <= c for x in starts))
    assert "__e_until" not in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
