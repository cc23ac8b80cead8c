"""Streams give the batch result, set late and bad rows aside without losing any, and survive a restart."""

import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepfold.operators import changes, overview
from stepfold.plans.lineage import scratch
from stepfold.schema import SAMPLES, TRANSITIONS
from stepfold.streaming import compaction, ingest, sinks, state
from tests import models

ROW = "trace_id string, storage_id bigint, cycle bigint, seq bigint, raw_bits bigint, state tinyint"
EVENT = ROW + ", event string"


def put(spark, path, rows, schema=ROW):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, out, schema=SAMPLES, **more):
    ingest.stream_changes(ingest.replay(spark, source, schema), out, **more).awaitTermination()


def test_stream_equals_batch_over_a_restart(spark):
    rows = models.random_samples(random.Random(2), 4, 150, 90)
    source, out = scratch(spark, "in"), scratch(spark, "out")
    for part in range(2):
        put(spark, source, [r for r in rows if r[2] // 30 == part])
    run(spark, source, out)
    put(spark, source, [r for r in rows if r[2] // 30 == 2] + [("t", 1, 5, 999, 1, 0)])
    run(spark, source, out)
    got = sorted(tuple(r) for r in ingest.read_changes(spark, out).select("storage_id", "cycle", "raw_bits", "state").collect())
    want = []
    for signal, events in models.written(rows).items():
        found = models.changes(events, 90)
        want += [(signal, *c) for i, c in enumerate(found) if not (i == 0 and c[1:] == (0, 0))]
    assert got == sorted(want)
    refused = {(r.seq, r.reason) for r in ingest.read_quarantine(spark, out).collect()}
    assert (999, "late") in refused
    assert {r for _, r in refused} == {"late", "duplicate_in_cycle"}
    batch = changes.compact_changes(spark.createDataFrame(rows, ROW), spans=(3,)).count()
    assert batch >= len(got)


def test_signals_come_and_go_over_a_restart(spark):
    """Absent before it is added, from its own start value, Z when removed, added again; every update is accepted or refused."""
    batches = [
        [("t", 1, 10, -1, 7, 0, "added"), ("t", 1, 4, 1, 5, 0, None), ("t", 1, 12, 2, 7, 0, None), ("t", 1, 13, 3, -(1 << 63), 0, None), ("t", 2, 0, -1, 0, 0, "added"), ("t", 9, 3, 4, 1, 0, None)],
        [("t", 1, 20, 99, 0, 0, "removed"), ("t", 1, 20, 5, 8, 0, None), ("t", 1, 21, 6, 9, 0, None), ("t", 2, 5, 7, 0, 0, None), ("t", 2, 6, 8, 1, 1, None), ("t", 1, 12, 9, 1, 0, None),
         ("t", 2, 7, 10, None, 0, None), (None, 2, 7, 11, 1, 0, None)],
        [("t", 1, 30, -1, 3, 0, "added"), ("t", 1, 30, 12, 4, 0, None), ("t", 1, 25, 13, 6, 0, None), ("t", 2, 40, -1, 1, 0, "added"), ("t", 9, 50, 99, 0, 0, "removed")],
    ]
    source, out = scratch(spark, "in"), scratch(spark, "out")
    for rows in batches:
        put(spark, source, rows, EVENT)
        run(spark, source, out, ingest.UPDATES, declared=True)
    got = sorted((r.storage_id, r.cycle, r.raw_bits, r.state) for r in ingest.read_changes(spark, out).collect())
    assert got == [(1, 10, 7, 0), (1, 13, -(1 << 63), 0), (1, 20, 0, 1), (1, 30, 4, 0), (2, 0, 0, 0), (2, 6, 1, 1)]
    refused = sorted((r.seq, r.reason) for r in ingest.read_quarantine(spark, out).collect())
    assert refused == [(-1, "already_added"), (1, "not_added"), (4, "not_added"), (5, "duplicate_in_cycle"), (6, "not_added"), (9, "late"), (10, "incomplete"), (11, "incomplete"),
                       (13, "not_added"), (99, "not_added")]
    assert {(r.trace_id, r.raw_bits) for r in ingest.read_quarantine(spark, out).where("seq IN (10, 11)").collect()} == {("t", None), (None, 1)}


def test_lifecycle_events_equal_the_batch(spark):
    signals = spark.createDataFrame([("t", 1, 1, 0, 0, None), ("t", 2, 2, 30, 2, None), ("t", 3, 3, 40, 0, 70), ("t", 4, 4, None, None, None)],
                                    "trace_id string, signal_id bigint, storage_id bigint, since_cycle bigint, initial_bits bigint, until_cycle bigint").withColumn("storage_only", F.lit(False))
    rows = models.random_samples(random.Random(5), 4, 200, 90)
    events = ingest.lifecycle_events(signals)
    source, out = scratch(spark, "in"), scratch(spark, "out")
    both = spark.createDataFrame(rows, ROW).withColumn("event", F.lit(None).cast("string")).unionByName(events)
    for part in range(3):
        both.where(f"least(cycle div 30, 2) = {part}").coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, ingest.UPDATES, declared=True)
    inside = spark.createDataFrame(rows, ROW).join(signals.select("storage_id", F.coalesce("since_cycle", F.lit(0)).alias("s"), F.coalesce("until_cycle", F.lit(1000)).alias("u")), "storage_id").where("cycle >= s AND cycle < u")
    removed = events.where("event = 'removed'").selectExpr("trace_id", "storage_id AS signal_id", "cycle", "0L AS raw_bits", "cast(1 AS tinyint) AS state")
    batch = changes.implicit_zero(changes.compact_changes(inside, spans=(3,)).withColumnRenamed("storage_id", "signal_id").unionByName(removed, allowMissingColumns=True).select(*TRANSITIONS.names), signals, spans=(3,))
    assert sorted(map(tuple, ingest.read_changes(spark, out).select("storage_id", "cycle", "raw_bits", "state").collect())) == sorted(map(tuple, batch.select("signal_id", "cycle", "raw_bits", "state").collect()))
    accepted = ingest.read_quarantine(spark, out).where("seq >= 0").count()
    assert 0 < accepted < len(rows)


def frame(*rows):
    return pd.DataFrame(rows, columns=["cycle", "seq", "raw_bits", "state", "event", "initial_bits", "reason"]).astype({"event": object, "reason": object}).assign(missing=0)


def test_declared_start():
    """A first value equal to the start that is declared is no change; a first zero after another start is one."""
    def changed(rows, last=None):
        out, new = state.judge_updates(rows, last, False)
        return [(r.cycle, r.raw_bits) for r in out.itertuples() if r.reason is None], new

    assert changed(frame((3, 0, 7, 0, None, 7, None), (4, 1, 8, 0, None, 7, None))) == ([(4, 8)], (4, 8, 0, True))
    assert changed(frame((3, 2, 0, 0, None, 7, None))) == ([(3, 0)], (3, 0, 0, True))
    assert changed(frame((3, 3, 0, 0, None, 0, None), (5, 4, 1, 0, None, 0, None))) == ([(5, 1)], (5, 1, 0, True))
    assert changed(frame((3, 0, 7, 0, None, 0, None)), (2, 7, 0, True)) == ([], (3, 7, 0, True))


def plain_windows(rows, buckets):
    """(signal, level, window): last change, one after the other."""
    out = {}
    for signal, cycle, bits, st in rows:
        for level, bucket in enumerate(buckets):
            out[signal, level, cycle // bucket * bucket] = (cycle, bits, st)
    return out


@pytest.mark.parametrize("restart", [False, True])
def test_all_levels_of_one_stream(spark, restart):
    """Signals far behind the others lose nothing; what is late for its own signal is set aside: accepted and refused are all."""
    rng = random.Random(7)
    rows = sorted({(s, rng.randrange(4000)) for s in range(5) for _ in range(200)}, key=lambda r: r[1])
    rows = [(s, c, rng.choice([0, 3, -1]), rng.choice([0, 0, 1])) for s, c in rows]
    lag = {s: s * 600 for s in range(5)}  # signal 4 arrives long after the others
    source, out, progress = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "progress")
    parts = [[r for r in rows if (r[1] + lag[r[0]]) // 1700 == k] for k in range(4)]
    parts[2] += [(0, 17, 9, 0), (3, 1, 9, 0)]  # late for their own signals
    parts[3] += [(s, 5000, None, None) for s in range(4)] + [(2, 5001, 9, 0), (4, None, 1, 0)]
    def go():
        sinks.stream_lod(ingest.replay(spark, source, TRANSITIONS), out, progress, 3, 100, 5).awaitTermination()

    for part in parts:
        put(spark, source, [("t", *r) for r in part], TRANSITIONS)
        if restart:
            go()
    if not restart:
        go()
    put(spark, source, [("t", 4, 5000, None, None)], TRANSITIONS)
    go()
    late = {(r.signal_id, r.cycle, r.reason) for r in sinks.read_late(spark, out).collect()}
    assert late == {(0, 17, "late"), (3, 1, "late"), (2, 5001, "after_end"), (4, None, "incomplete")}
    got = {(r.signal_id, r.level, r.window_start): (r.cycle, r.raw_bits, r.state) for r in sinks.read_lod(spark, out).collect()}
    assert got == plain_windows(rows, [100, 500, 2500])
    batch = overview.lod_pyramid(spark.createDataFrame([("t", *r) for r in rows], TRANSITIONS), 3, 100, 5)
    assert sorted(map(str, sinks.read_lod(spark, out).collect())) == sorted(map(str, batch.select(*sinks.read_lod(spark, out).columns).collect()))


def tiled_rows(spark, path):
    return sorted(tuple(r)[:5] for r in compaction.read_tiles(spark, path).select(*TRANSITIONS.names).collect())


def test_closed_tiles_are_rewritten_while_others_come(spark):
    """One file for each closed tile, every row once at any time, also late ones; a killed rewrite and a killed batch are repeated."""
    rng = random.Random(9)
    rows = sorted({("t", rng.randint(1, 6), rng.randrange(90)) for _ in range(250)}, key=lambda r: r[2])
    rows = [(*r, rng.randrange(5), 0) for r in rows]
    source, path, progress = scratch(spark, "in"), scratch(spark, "tiles"), scratch(spark, "progress")
    sent = []

    def send(part):
        sent.extend(part)
        put(spark, source, part, TRANSITIONS)
        compaction.stream_appended(ingest.replay(spark, source, TRANSITIONS), path, progress, 10, 4).awaitTermination()
        assert tiled_rows(spark, path) == sorted(sent)

    def files(blocks):
        held = spark.read.parquet(f"{path}/closed").withColumn("file", F.input_file_name()).where(F.col("time_block").isin(blocks))
        _, closed = compaction._last_rewrite(spark, path)
        held = held.join(closed.selectExpr("time_block", "signal_chunk", "held_by AS rewrite"), ["time_block", "signal_chunk", "rewrite"])
        return [r["n"] for r in held.groupBy("time_block", "signal_chunk").agg(F.count_distinct("file").alias("n")).collect()]

    for k in range(4):
        send([r for r in rows if k * 12 <= r[2] < k * 12 + 12])
    before = compaction.read_tiles(spark, path)  # planned before the rewrite
    assert compaction.rewrite_closed(spark, path) == 8 and compaction.rewrite_closed(spark, path) == 0
    assert tiled_rows(spark, path) == sorted(sent) == sorted(tuple(r)[:5] for r in before.select(*TRANSITIONS.names).collect())
    assert files([0, 1, 2, 3]) == [1] * 8
    send([r for r in rows if 48 <= r[2] < 70] + [("t", 2, 5, 77, 0)])  # one for a tile that is closed
    assert compaction.rewrite_closed(spark, path) == 2 * 2 + 1 and files(list(range(6))) == [1] * 12
    assert tiled_rows(spark, path) == sorted(sent)
    # A rewrite that dies before its log: what it wrote isn't read, and the next one replaces it.
    spark.createDataFrame([("t", 1, 1, 1, 1)], TRANSITIONS).selectExpr("*", "0L AS time_block", "0L AS signal_chunk").write.partitionBy("time_block", "signal_chunk").parquet(f"{path}/closed/rewrite=2")
    # So does a batch.
    spark.createDataFrame([("t", 1, 1, 1, 1)], TRANSITIONS).selectExpr("*", "0L AS time_block", "0L AS signal_chunk").write.partitionBy("time_block", "signal_chunk").parquet(f"{path}/appended/batch=5")
    assert tiled_rows(spark, path) == sorted(sent)
    send([r for r in rows if r[2] >= 70])
    assert compaction.rewrite_closed(spark, path, ended=True) == 2 * 3 and files(list(range(9))) == [1] * 18
    assert tiled_rows(spark, path) == sorted(sent) == sorted(rows + [("t", 2, 5, 77, 0)])


def test_neighbouring_signals_share_state(spark):
    """600 signals are three entries of the state, in both streams, and each is judged by its own last value."""
    rows = [("t", s, c, s * 10 + c, s % 3 + c, 0) for s in range(600) for c in range(2)]
    source, out = scratch(spark, "in"), scratch(spark, "out")
    put(spark, source, rows)
    query = ingest.stream_changes(ingest.replay(spark, source, SAMPLES), out)
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal == 3
    put(spark, source, [("t", 5, 0, 9001, 7, 0), ("t", 6, 2, 9002, 1, 0), ("t", 599, 2, 9003, 9, 0)])
    run(spark, source, out)
    got = sorted((r.storage_id, r.cycle, r.raw_bits) for r in ingest.read_changes(spark, out).collect())
    assert got == sorted([(s, c, s % 3 + c) for s in range(600) for c in range(2) if s % 3 + c] + [(599, 2, 9)])
    assert [(r.storage_id, r.reason) for r in ingest.read_quarantine(spark, out).collect()] == [(5, "late")]
    source, out = scratch(spark, "in"), scratch(spark, "out")
    put(spark, source, [("t", s, c, s, 0) for s in range(600) for c in (0, 150)], TRANSITIONS)
    query = sinks.stream_lod(ingest.replay(spark, source, TRANSITIONS), out, scratch(spark, "progress"), 1, 100, 5)
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal == 3
    assert sorted((r.signal_id, r.cycle) for r in sinks.read_lod(spark, out).collect()) == [(s, 0) for s in range(600)]


@pytest.mark.parametrize("declared", [False, True])
def test_signals_together_as_one_by_one(declared):
    """Some signals in one call give what each gives alone, over several batches."""
    rng = random.Random(11)
    together, alone = state.held(None), {}
    for batch in range(4):
        rows = [(s, rng.randrange(batch * 10, batch * 10 + 15), i, rng.randrange(3), rng.choice([0, 0, 1]), rng.choice([None] * 5 + ["added", "removed"]), s % 2, rng.choice([None] * 6 + ["incomplete"]))
                for i, s in enumerate(rng.choices(range(6), k=60))]
        whole = frame(*[r[1:] for r in rows]).assign(storage_id=[r[0] for r in rows])
        out, together = state.judge_signals(whole, together, declared)
        want = []
        for s in sorted({r[0] for r in rows}):
            part, alone[s] = state.judge_updates(whole[whole["storage_id"] == s].drop(columns="storage_id"), alone.get(s), declared)
            want += [(s, r.cycle, r.seq, r.raw_bits, r.state, r.reason) for r in part.itertuples()]
        assert sorted(map(str, want)) == sorted(str((r.storage_id, r.cycle, r.seq, r.raw_bits, r.state, r.reason)) for r in out.itertuples())
        assert {s: x for s, x in alone.items() if x} == {int(r[0]): tuple(x.item() for x in r[1:]) for r in zip(*together)}


def test_rewrite_reads_the_blocks_it_rewrites(spark):
    """Tiles that are closed and have no new rows are not opened by the next rewrite."""
    source, path, progress = scratch(spark, "in"), scratch(spark, "tiles"), scratch(spark, "progress")
    for k in range(3):
        put(spark, source, [("t", s, c, c, 0) for s in (1, 2) for c in range(k * 20, k * 20 + 20)], TRANSITIONS)
        compaction.stream_appended(ingest.replay(spark, source, TRANSITIONS), path, progress, 10, 4).awaitTermination()
        assert compaction.rewrite_closed(spark, path) == (1 if k == 0 else 2)
        if k == 0:
            (file,) = Path(path, "closed/rewrite=0/time_block=0/signal_chunk=0").glob("*.parquet")
            whole = file.read_bytes()
            file.write_bytes(b"unreadable" * 20)
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    file.write_bytes(whole)
    assert tiled_rows(spark, path) == sorted(("t", s, c, c, 0) for s in (1, 2) for c in range(60))
