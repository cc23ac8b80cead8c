"""Hierarchy: paths, faults, search."""

from stepfold.operators import checks, tree

NODE = "trace_id string, node_id bigint, parent_id bigint, ordinal int, name string, node_kind string"


def nodes(spark, rows):
    return spark.createDataFrame([("t", i, p, o, n, k) for i, p, o, n, k in rows], NODE)


def test_deep_paths_index_segments_and_faults(spark):
    chain = [(i, i - 1, 0, f"n{i}", "Object") for i in range(1, 41)]
    faults = [(50, 99, 0, "orphan", "Object"), (51, 50, 0, "below", "Object"), (60, 61, 0, "x", "Object"), (61, 62, 0, "y", "Object"),
              (62, 60, 0, "z", "Object"), (63, 62, 0, "hang", "Object"), (70, 70, 0, "self", "Object")]
    index = [(80, 40, 1, "[3]", "Object"), (81, 80, 0, "leaf", "SignalLeaf")]
    got = {r.node_id: r for r in tree.node_paths(nodes(spark, chain + faults + index)).collect()}
    assert set(got) == set(range(1, 41)) | {80, 81}
    assert got[40].path == ".".join(f"n{i}" for i in range(1, 41)) and got[40].depth == 39
    assert got[81].path == got[40].path + "[3].leaf" and got[81].ancestors == [*range(1, 41), 80]


def test_search(spark):
    rows = [(1, 0, 0, "top", "Root"), (2, 1, 0, "a", "Object"), (3, 2, 1, "b", "Object"), (4, 2, 0, "b", "SignalLeaf"), (5, 3, 0, "a", "Object"),
            (6, 5, 0, "A b", "SignalLeaf")]
    named = nodes(spark, rows).join(spark.createDataFrame([("t", 4, 10, 8), ("t", 6, 11, 1)], "trace_id string, node_id bigint, signal_id bigint, width int"),
                                    ["trace_id", "node_id"], "left")
    ends = lambda q, **k: [(r.start_id, r.node_id) for r in tree.search_nodes(named, q, **k).collect()]
    assert ends("B") == [(3, 3), (4, 4), (6, 6)]
    assert ends("[7:0]") == [(4, 4)]
    assert ends("a. b") == [(2, 4), (5, 6)]
    assert ends("a.b", all_ends=True) == [(2, 3), (2, 4), (5, 6)]
    assert ends("b.a") == [(3, 5)] and ends(" . ") == []


def test_topology_report_is_empty_for_a_sound_layout(spark):
    layout = nodes(spark, [(1, 0, 0, "top", "Root"), (2, 1, 0, "a", "SignalLeaf")])
    signals = spark.createDataFrame([("t", 1, 1, 2, 1, 0, "Bool", "auto", False)],
                                    "trace_id string, signal_id bigint, storage_id bigint, node_id bigint, width int, bit_offset int, "
                                    "value_type string, radix string, storage_only boolean")
    clocks = spark.createDataFrame([("t", 1, True, 5)], "trace_id string, signal_id bigint, initial_value boolean, period_ticks bigint")
    assert checks.check_topology(layout, signals, clocks).isEmpty()


def test_chain_deeper_than_4096_and_more_than_5000_hits(spark):
    n = 4500
    deep = spark.range(1, n + 1).selectExpr("'t' AS trace_id", "id AS node_id", "id - 1 AS parent_id", "0 AS ordinal", "'n' AS name", "'Object' AS node_kind")
    paths = tree.node_paths(deep)
    assert paths.selectExpr("count(*)", "max(depth)").first() == (n, n - 1)
    wide = spark.range(1, 6002).selectExpr("'t' AS trace_id", "id AS node_id", "IF(id = 1, 0, 1) AS parent_id", "0 AS ordinal", "'leaf' AS name",
                                           "CAST(NULL AS BIGINT) AS signal_id", "1 AS width")
    assert tree.search_nodes(wide, "leaf").count() == 6001
