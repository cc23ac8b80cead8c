"""Overviews against models that take one transition after the other."""

import random

import pytest

from stepfold.operators import overview
from stepfold.schema import TRANSITIONS

SPANS = (4, 3)


def recorded(samples, buckets, share):
    """(level, window_start): transition, as a recorder with a running budget keeps them."""
    kept, pending = [[] for _ in buckets], [None] * len(buckets)
    for n, sample in enumerate(samples):
        source = n + 1
        for level, bucket in enumerate(buckets):
            window = sample[0] // bucket * bucket
            if pending[level] is not None and pending[level][0] != window and len(kept[level]) + 1 <= source // share:
                kept[level].append(pending[level])
            pending[level] = (window, sample)
            source = len(kept[level]) + 1
    return {(level, window): sample for level in range(len(buckets)) for window, sample in [*kept[level], *([pending[level]] if samples else [])]}


@pytest.mark.parametrize("share", [2, 3, 5])
def test_running_budget_on_changing_density(spark, share):
    rng = random.Random(share)
    samples = {}
    for signal in range(1, 7):
        at, own = rng.randrange(5), []
        for phase in range(6):  # dense and sparse stretches by turns, in another order for each signal
            for _ in range(rng.randint(0, 60)):
                own.append((at, rng.choice([0, 1, -1]), rng.choice([0, 1])))
                at += rng.choice([1, 1, 2]) if (phase + signal) % 2 else rng.randint(5, 60)
        samples[signal] = own
    rows = [("t", s, *x) for s, own in samples.items() for x in own] + [("t", 1, -3, 1, 0)]
    frame = spark.createDataFrame(rows, TRANSITIONS)
    found = overview.budgeted_pyramid(frame, 3, 4, 3, share, SPANS).collect()
    got = {(r.signal_id, r.level, r.window_start): (r.cycle, r.raw_bits, r.state) for r in found}
    want = {(s, *k): v for s, own in samples.items() for k, v in recorded(own, [4, 12, 36], share).items()}
    assert got == want and len(found) == len(got)
    everything = overview.lod_pyramid(frame.where("cycle >= 0"), 3, 4, 3).count()
    assert len(got) < everything
    assert overview.budgeted_pyramid(frame.limit(0), 2).isEmpty()


def walked(samples, t0, t1, stride, parity):
    inside = [i for i, s in enumerate(samples) if t0 <= s[0] <= t1]
    out = {max((s for s in samples if s[0] < t0), default=None)} - {None}
    if inside:
        i = 0
        own = [samples[k] for k in inside]
        while i is not None:
            out |= {own[i], own[max(i - 1, 0)]}
            i = next((k for k in range(i + 1, len(own)) if own[k][0] >= own[i][0] + stride and (not parity or (k - i) % 2)), None)
        out.add(own[-1])
    return out


@pytest.mark.parametrize("parity", [False, True])
@pytest.mark.parametrize("stride", [1, 7, 40, 1000])
def test_hops(spark, stride, parity):
    rng = random.Random(stride)
    samples = {s: sorted({(rng.randrange(0, 60 * s), s, 0) for _ in range(12 * s)}) for s in range(1, 6)}
    rows = [("t", s, *x) for s, own in samples.items() for x in own]
    found = overview.hops(spark.createDataFrame(rows, TRANSITIONS), 20, 230, stride, parity, SPANS).collect()
    got = {(r.signal_id, r.cycle) for r in found}
    assert got == {(s, x[0]) for s, own in samples.items() for x in walked(own, 20, 230, stride, parity)} and len(found) == len(got)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_cells_are_spread_out_after_the_sums(spark):
    rng = random.Random(3)
    rows, cells = [], {}
    for signal in range(1, 5):
        times = sorted({0 if signal == 1 else 7, *(rng.randrange(8, 900) for _ in range(40))})
        values = [(rng.choice([0, 1]), rng.choice([0, 0, 1])) for _ in times]
        for i, (at, end) in enumerate(zip(times, [*times[1:], 900], strict=True)):
            before = values[i - 1] if i else (None, None)
            rows.append(("t", signal, at, at, end, *values[i], *before))
            if end <= 100 or at >= 600:
                continue
            mask, was = (overview.SEEN_Z if s else (overview.SEEN_NONZERO if b else overview.SEEN_ZERO) if s is not None else None for b, s in (values[i], before))
            x1, x2 = (((min(max(t, 100), 600) - 100) * 100 + 500) // 1000 for t in (at, end))
            for x in range(x1, x2):
                cells.setdefault((signal, x), [0, 0])[0] |= mask
            if at >= 100 and was is not None and was != mask and x1 < 50:
                cells.setdefault((signal, x1), [0, 0])[1] += 1
    segments = spark.createDataFrame(rows, "trace_id string, signal_id long, cycle long, start long, end long, raw_bits long, state tinyint, prev_bits long, prev_state tinyint")
    raster = overview.viewport_raster(segments, 100, 600, 50)
    found = raster.collect()
    assert {(r.signal_id, r.x): [r.state_mask, r.changes] for r in found} == cells and len(found) == len(cells)
    plan = plan_of(raster)
    assert plan.index("Generate") < plan.index("Aggregate")  # printed from the last step to the first


def test_levels_share_a_shuffle(spark):
    rng = random.Random(4)
    rows = [("t", s, c, c * s, 0) for s in range(1, 5) for c in sorted({-5, *(rng.randrange(0, 3_000) for _ in range(60 * s))})]
    frame = spark.createDataFrame(rows, TRANSITIONS)
    found = overview.lod_pyramid(frame, 4, 3, 5, SPANS).collect()
    want = {}
    for _, signal, cycle, bits, _ in rows:
        for level in range(4):
            size = 3 * 5 ** level
            want[signal, level, size, max(cycle, 0) // size * size] = (cycle, bits)  # the last one stays
    assert {(r.signal_id, r.level, r.bucket, r.window_start): (r.cycle, r.raw_bits) for r in found} == want and len(found) == len(want)
    assert plan_of(overview.lod_pyramid(frame, 2)).count("Exchange") == plan_of(overview.lod_pyramid(frame, 7)).count("Exchange")
