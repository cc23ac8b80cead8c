"""Compaction and what builds on it, against cycle-by-cycle answers and across block edges."""

import random

import pytest
from pyspark.sql import functions as F

from stepfold.operators import changes, joins, search
from stepfold.operators.blocks import ahead, held, next_, prev, scan, total
from tests import models

SPANS = [(), (3,), (2, 2), (17, 16)]
PLAIN_AND_BLOCKED = SPANS[::2]
CYCLES = 60


@pytest.fixture(scope="module")
def trace(spark):
    rng = random.Random(5)
    rows = models.random_samples(rng, 4, 160, CYCLES)
    return models.written(rows), spark.createDataFrame(rows, models.SAMPLE).cache()


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def expected_changes(written):
    return sorted((s, *c) for s, events in written.items() for c in models.changes(events, CYCLES))


@pytest.mark.parametrize("spans", SPANS)
def test_scan_outputs(spark, spans):
    rng = random.Random(9)
    rows = [(k, c, rng.randrange(9) if rng.random() < 0.6 else None) for k in (1, 2, 3)
            for c in rng.sample(range(200), 80 if k == 1 else 9)]
    df = spark.createDataFrame(rows, "k bigint, c bigint, v bigint").withColumn("w", F.coalesce("v", F.lit(0)))
    got = scan(df, ["k"], "c", [prev("c", "p"), next_("c", "n"), held("v", "h"), ahead("v", "a"), total("w", "t")], spans)
    want = []
    for k in (1, 2, 3):
        own = sorted((c, v) for kk, c, v in rows if kk == k)
        for i, (c, _) in enumerate(own):
            before, after = own[:i], own[i + 1:]
            known_before = [v for _, v in before if v is not None]
            known_after = [v for _, v in after if v is not None]
            want.append((k, c, before[-1][0] if before else None, after[0][0] if after else None,
                         known_before[-1] if known_before else None, known_after[0] if known_after else None, sum(known_before)))
    assert sorted(map(tuple, got.select("k", "c", "p", "n", "h", "a", "t").collect()), key=lambda r: r[:2]) == sorted(
        want, key=lambda r: r[:2])


@pytest.mark.parametrize("spans", SPANS)
def test_compact_changes(trace, spans):
    written, rows = trace
    once = changes.compact_changes(rows, "signal_id", spans)
    assert collected(once, "signal_id", "cycle", "raw_bits", "state") == expected_changes(written)
    again = changes.drop_repeats(once, spans=spans)
    assert collected(again, "signal_id", "cycle", "raw_bits", "state") == expected_changes(written)


def test_implicit_zero_and_late_signals(spark):
    rows = models.events_table(spark, {1: {3: (5, 0)}, 2: {0: (7, 0)}, 3: {4: (0, 0)}, 5: {9: (6, 0)}})
    signals = spark.createDataFrame(
        [("t", 1, False, None, None), ("t", 2, False, 0, 0), ("t", 3, False, None, None), ("t", 4, True, None, None), ("t", 5, False, 6, 6)],
        "trace_id string, signal_id bigint, storage_only boolean, since_cycle bigint, initial_bits bigint")
    got = changes.implicit_zero(rows, signals, (2,))
    assert collected(got, "signal_id", "cycle", "raw_bits") == [(1, 0, 0), (1, 3, 5), (2, 0, 7), (3, 0, 0), (5, 6, 6)]


def test_aliases_share_a_stream(spark):
    rows = spark.createDataFrame([("t", 1, 1, 0, 0x1203, 0), ("t", 1, 2, 1, 0x1304, 0), ("t", 1, 3, 2, 0x1305, 0), ("t", 1, 4, 3, 0, 1)],
                                 "trace_id string, storage_id bigint, cycle bigint, seq bigint, raw_bits bigint, state tinyint")
    signals = spark.createDataFrame([("t", 1, 1, 8, 0, False), ("t", 1, 2, 8, 8, False), ("t", 1, 9, 16, 0, True)],
                                    "trace_id string, storage_id bigint, signal_id bigint, width int, bit_offset int, storage_only boolean")
    got = changes.fan_out_aliases(rows, signals, (1,))
    assert collected(got, "signal_id", "cycle", "raw_bits", "state") == [
        (1, 1, 3, 0), (1, 2, 4, 0), (1, 3, 5, 0), (1, 4, 0, 1), (2, 1, 0x12, 0), (2, 2, 0x13, 0), (2, 4, 0, 1)]


def test_byte_booleans(spark):
    rows = spark.createDataFrame([("t", 1, 0, 0, 0, 0), ("t", 1, 1, 1, 2, 0), ("t", 1, 2, 2, 1, 0)], models.SAMPLE)
    got = changes.compact_changes(changes.bool_storage(rows), "signal_id")
    assert collected(got, "cycle", "raw_bits") == [(0, 0), (1, 1)]


@pytest.mark.parametrize("spans", PLAIN_AND_BLOCKED)
def test_value_at_every_cycle(spark, trace, spans):
    written, rows = trace
    probes = spark.range(CYCLES).select(F.lit("t").alias("trace_id"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(6).cast("bigint"))).alias("signal_id"),
                                        F.col("id").alias("cycle"))
    got = joins.value_at(changes.last_writes(rows, "signal_id"), probes.unionByName(probes), spans)
    want = sorted((s, c, *models.value(written.get(s, {}), c)) for s in range(1, 7) for c in range(CYCLES))
    assert collected(got, "signal_id", "cycle", "raw_bits", "state") == want


@pytest.mark.parametrize("spans", PLAIN_AND_BLOCKED)
def test_segments_tile_the_range(spark, trace, spans):
    written, rows = trace
    meta = spark.createDataFrame([("t", "x", "1ns", 0, 50)], "trace_id string, title string, timescale string, start bigint, end bigint")
    got = changes.segments(changes.compact_changes(rows, "signal_id", spans), meta, spans=spans)
    shown = {(r.signal_id, c): (r.raw_bits, r.state) for r in got.collect() for c in range(r.start, r.end)}
    want = {(s, c): models.value(e, c) for s, e in written.items() for c in range(50) if models.value(e, c) != models.ABSENT}
    assert shown == want


@pytest.mark.parametrize("spans", PLAIN_AND_BLOCKED)
def test_find_value_runs(spark, trace, spans):
    written, rows = trace
    signals = spark.createDataFrame([("t", s, f"s{s}", 1 if s == 3 else 2) for s in (1, 2, 3, 4)],
                                    "trace_id string, signal_id bigint, path string, width int")
    compact = changes.compact_changes(rows, "signal_id", spans)
    got = collected(search.find_value(compact, signals, " 0x2 ", spans), "signal_id", "cycle", "sample_index")
    want = []
    for s, events in written.items():
        for i, (c, bits, state) in enumerate(models.changes(events, CYCLES)):
            if s != 3 and state == 0 and bits == 2:
                want.append((s, c, i))
    assert got == sorted(want)


@pytest.mark.parametrize("text,target", [("2", (2, False)), ("0x2", (2, False)), ("0b10", (2, False)), ("10", (10, False)),
                                         ("ff", (255, False)), ("-1", (-1, True)), ("zz", None), ("", None), ("-x", None), ("0x", None),
                                         ("18446744073709551616", None), ("18446744073709551615", ((1 << 64) - 1, False))])
def test_find_target(text, target):
    assert search.find_target(text) == target


@pytest.mark.parametrize("spans", PLAIN_AND_BLOCKED)
def test_neighbouring_changes(spark, trace, spans):
    written, rows = trace
    times = sorted({c for e in written.values() for c, *_ in models.changes(e, CYCLES)[1:]})
    compact = changes.compact_changes(rows, "signal_id", spans)
    probes = spark.range(CYCLES).select(F.lit("t").alias("trace_id"), F.col("id").alias("cycle"))
    after = collected(search.next_change(compact, probes, spans), "cycle", "target")
    before = collected(search.prev_change(compact, probes, spans), "cycle", "target")
    assert after == [(c, min(t for t in times if t > c)) for c in range(CYCLES) if any(t > c for t in times)]
    assert before == [(c, max(t for t in times if t < c)) for c in range(CYCLES) if any(t < c for t in times)]
