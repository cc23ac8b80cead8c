"""Files, tiles, documents and generated rows."""

import json
import os

from pyspark.sql import functions as F

from stepfold.functions.values import normalize_values, value_text
from stepfold.operators.periodic import detect_periodic
from stepfold.plans.lineage import scratch
from stepfold.schema import TRANSITIONS
from stepfold.sources import json_trace, synthetic, tiles
from tests import models


def plan_of(df):
    return df._jdf.queryExecution().toString() + df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_tiles_prune(spark):
    events = {s: {c: (c % 3, 0) for c in range(0, 400, 7)} for s in (1, 2, 5, 9)}
    path = scratch(spark, "t")
    tiles.write_tiled(models.events_table(spark, events), path, span=100, chunk=4)
    loaded = tiles.load_signals(tiles.read_tiled(spark, path), [5, 9], 120, 199, span=100, chunk=4)
    text = plan_of(loaded)
    filters = [line for line in text.splitlines() if "PartitionFilters" in line]
    assert filters and "time_block" in filters[0] and "signal_chunk" in filters[0]
    assert any("PushedFilters" in line and "cycle" in line for line in text.splitlines())
    assert sorted((r.signal_id, r.cycle) for r in loaded.collect()) == [(s, c) for s in (5, 9) for c in range(126, 200, 7)]
    assert tiles.load_signals(tiles.read_tiled(spark, path), [5], 9, 3, span=100, chunk=4).count() == len(events[5])
    empty = tiles.load_signals(tiles.read_tiled(spark, path), None, 9000, 9100, span=100, chunk=4, fallback=True)
    assert empty.count() == sum(len(e) for e in events.values())


def test_carry_in_with_and_without_snapshots(spark):
    events = {1: {0: (4, 0), 30: (5, 0), 260: (6, 0)}, 2: {250: (7, 0)}, 3: {210: (0, 1)}}
    table = models.events_table(spark, events)
    path = scratch(spark, "t")
    tiles.write_tiled(table, path, span=100, chunk=4)
    tiled, snapshots = tiles.read_tiled(spark, path), tiles.block_snapshots(table, 100)
    for given in (None, snapshots):
        got = tiles.load_window_carry_in(tiled, None, 220, 255, given, span=100, chunk=4)
        assert sorted((r.signal_id, r.cycle, r.raw_bits, r.state) for r in got.collect()) == [(1, 220, 5, 0), (2, 250, 7, 0), (3, 220, 0, 1)]


def test_documents(spark):
    good = {"meta": {"title": "x", "timescale": "1ns", "start": "0", "end": "0"}, "signals": [
        {"name": "a", "samples": [["3", "1"], ["9", True], ["12", "10"]]},
        {"name": "b", "kind": "BUS", "width": 8, "samples": [["5", "0x1f"], ["6", 300], ["7", None], ["8", "Z"], [9, "1"], ["10"]]}]}
    docs = spark.createDataFrame([("g", json.dumps(good)), ("h", '{"meta":{"start":1,"end":"2"},"signals":[{"kind":"bit"}]}'), ("i", "{}")],
                                 "trace_id string, text string")
    trace = json_trace.parse_json_traces(docs)
    assert sorted((r.signal_id, r.cycle, r.raw_bits, r.state) for r in trace.samples.where("trace_id='g'").collect()) == [
        (1, 3, 1, 0), (1, 9, 1, 0), (1, 12, 0, 0), (2, 5, 31, 0), (2, 6, 300 & 255, 0), (2, 7, 0, 0), (2, 8, 0, 1)]
    heads = {r.trace_id: (r.title, r.start, r.end) for r in trace.meta.collect()}
    assert heads["g"] == ("x", 3, 12) and heads["i"] == ("custom_wave", 0, 100)
    rules = sorted((r.trace_id, r.rule) for r in trace.errors.collect())
    assert rules == [("g", "sample_too_short"), ("g", "time_not_text"), ("h", "meta_start_not_text"), ("h", "name_missing"),
                     ("h", "samples_missing"), ("i", "signals_missing")]
    kinds = {(r.trace_id, r.signal_id): (r.kind, r.width, r.radix) for r in trace.signals.collect()}
    assert kinds[("g", 1)] == ("bit", 1, "bin") and kinds[("g", 2)] == ("bus", 8, "hex")


def test_export_round_trip(spark):
    events = {1: {c: (c * 37 % 256, 0) for c in range(0, 300, 11)}, 2: {4: (0, 1), 9: (1, 0), 11: (0, 2)}}
    signals = spark.createDataFrame([("t", 1, "a", "bus", 8, "hex"), ("t", 2, "b", "bit", 1, "bin"), ("t", 3, "c", "bit", 1, "bin")],
                                    "trace_id string, signal_id bigint, name string, kind string, width int, radix string")
    meta = spark.createDataFrame([("t", "run", "1ns", 3, 400)], "trace_id string, title string, timescale string, start bigint, end bigint")
    rows = models.events_table(spark, events)
    lines = json_trace.json_lines(meta, signals, rows, part_cycles=64)
    bodies = [(r.signal_id, r.part, json.loads(r.line)["signals"][0]) for r in lines.collect()]
    assert max(len(b["samples"]) for _, _, b in bodies) <= 64
    assert [b["samples"] for s, _, b in bodies if s == 3] == [[]]
    texts = spark.createDataFrame([(b["kind"], b["width"], s, t, v) for s, _, b in bodies for t, v in b["samples"]],
                                  "kind string, width int, signal_id bigint, time string, value string")
    back = sorted((r.signal_id, int(r.time), r.raw_bits, r.state) for r in normalize_values(texts).collect())
    assert back == sorted((s, c, *v) for s, e in events.items() for c, v in e.items())

    path = scratch(spark, "export")
    json_trace.write_json_trace(meta, signals, rows, path, "(none)", part_cycles=64)
    read = json_trace.read_json_trace(spark, path, "(none)", lines=True)
    assert [tuple(r) for r in read.meta.collect()] == [("t", "run", "1ns", 3, 400)]
    assert sorted(read.samples.select(*TRANSITIONS.names).collect()) == sorted(rows.select(*TRANSITIONS.names).collect())
    assert sorted(tuple(r) for r in read.signals.collect()) == sorted(tuple(r) for r in signals.collect())
    assert read.errors.isEmpty()


def test_files_of_one_name_are_two_traces(spark):
    path = scratch(spark, "runs")
    for folder, value in (("a", "\\t0x1F\\n"), ("b", "2")):
        os.makedirs(f"{path}/{folder}")
        with open(f"{path}/{folder}/run.json", "w") as f:
            f.write('{"meta":{"title":"x","timescale":"1s","start":"0","end":"9"},"signals":[{"name":"s","kind":" BUS\\n","width":8,'
                    '"samples":[["\\t0 ","%s"],["5","(none)"]]}]}' % value)
    read = json_trace.read_json_trace(spark, f"{path}/*", "(none)")
    got = sorted((r.trace_id.rsplit("/", 2)[-2], r.cycle, r.raw_bits, r.state) for r in read.samples.collect())
    assert got == [("a", 0, 31, 0), ("a", 5, 0, 2), ("b", 0, 2, 0), ("b", 5, 0, 2)]


def test_text_of_floats(spark):
    import struct

    values = [1.0, -2.5, 1e10, 3.4e38, 1.5e-7, 0.1, 123456.78, float("inf"), -0.0, 16777216.0]
    rows = [(struct.unpack("<i", struct.pack("<f", v))[0] & 0xFFFFFFFF, 0, 32, "float") for v in values]
    rows += [(struct.unpack("<q", struct.pack("<d", v))[0], 0, 64, "double") for v in values] + [(5, 0, 16, "float"), (5, 0, 32, "double")]
    df = spark.createDataFrame(rows, "b bigint, s tinyint, w int, r string")
    got = [r[0] for r in df.select(value_text(F.col("b"), F.col("s"), F.col("w"), F.col("r"))).collect()]
    assert got[:10] == ["1.0", "-2.5", "1.0e+10", "3.4e+38", "1.5000001e-07", "0.1", "123456.78", "inf", "-0.0", "16777216.0"]
    assert got[10:20] == ["1.0", "-2.5", "10000000000.0", "3.4e+38", "1.5e-07", "0.1", "123456.78", "inf", "-0.0", "16777216.0"]
    assert got[20:] == ["N/A", "N/A"]


def test_clocks_in_parts(spark):
    clocks = spark.createDataFrame([("t", 1, True, 3), ("t", 2, False, 50)], "trace_id string, signal_id bigint, initial_value boolean, period_ticks bigint")
    meta = spark.createDataFrame([("t", 40)], "trace_id string, end bigint")
    rows = sorted((r.signal_id, r.cycle, r.raw_bits) for r in synthetic.synthetic_clock(clocks, meta, part=4).collect())
    assert rows == [(1, 3 * k, (1 + k) % 2) for k in range(14)] + [(2, 0, 0)]
    window = synthetic.synthetic_clock(clocks, meta, 10, 20, part=4).where("signal_id = 1").collect()
    assert sorted(r.cycle for r in window) == [12, 15, 18]
    assert synthetic.synthetic_clock(clocks, meta, max_toggles=5).count() == 6


def test_workload_is_deterministic(spark):
    one = synthetic.synthetic_trace(spark, 600, 50)
    assert sorted(one.collect()) == sorted(synthetic.synthetic_trace(spark, 600, 50).repartition(7).collect())
    per = {r.storage_id: r["count"] for r in one.groupBy("storage_id").count().collect()}
    assert (per[1], per[3], per[6]) == (600, 150, 20)
    assert one.groupBy("storage_id", "cycle").count().where("count > 1").isEmpty()


def test_periodic_cases(spark):
    exact = {c: ((c // 10) % 2, 0) for c in range(10, 100, 10)}
    jitter = {(c if c != 50 else 51): v for c, v in exact.items()}
    short = {c: v for c, v in exact.items() if c <= 50}
    stuck = {c: (1, 0) for c in range(10, 100, 10)}
    events = {1: exact, 2: jitter, 3: short, 4: stuck, 5: {0: (0, 0), **exact}}
    signals = spark.createDataFrame([("t", s, "bit") for s in events], "trace_id string, signal_id bigint, kind string")
    table = models.events_table(spark, events)
    found = sorted((r.signal_id, r.first_offset, r.half_period, r.toggles) for r in detect_periodic(table, signals, 1000, spans=(4, 2)).collect())
    assert found == [(1, 10, 10, 9), (5, 10, 10, 9)]
    assert 2 in {r.signal_id for r in detect_periodic(table, signals, 1000, tolerance=1).collect()}
