"""Registered queries on the smallest tables: against their SQL, or against plain versions."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepfold.llm import line_dedup, near_dedup
from stepfold.llm.components import components
from stepfold.llm.queries import REGISTRY, SQL, table
from tests.llm import brute
from tests.oracle_compare import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert compare(REGISTRY[name](spark, SF_DIR), duck(SF_DIR), SQL[name]) == []


def test_there_is_one_query_of_each_number():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))


@pytest.mark.parametrize("node", [near_dedup.NODE, 3])
def test_near_groups(spark, texts, node):
    """With tiny nodes all levels of branching, blocks and pivots are used."""
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(table(spark, SF_DIR, "documents"), node=node).collect()}
    assert got == brute.near_groups(texts)


def test_near_groups_of_planted_copies(spark):
    """Pairs at and just below the threshold, a chain, and a star whose rays are only near its centre."""
    words = [f"w{i}" for i in range(400)]
    docs = [(10, " ".join(words[:104]))]
    docs += [(20 + k, " ".join(words[:104 - k])) for k in range(20, 30)]  # 80 of 100 shingles and fewer
    docs += [(100 + k, " ".join(words[150 + 5 * k:250 + 5 * k])) for k in range(20)]  # a chain
    for k in range(40):  # rays: one word of a long text changed each
        ray = list(words[:60])
        ray[k + 8] = f"x{k}"
        docs.append((300 + k, " ".join(ray)))
    docs.append((299, " ".join(words[:60])))
    want = brute.near_groups(docs)
    for node in (near_dedup.NODE, 6):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string"), node=node).collect()}
        assert got == want


def test_line_matches(spark, texts):
    got = {(r.doc_id, r.line): (r.first_doc, r.first_line) for r in line_dedup.later_matches(table(spark, SF_DIR, "documents")).collect()}
    want = brute.later_lines(texts)
    assert got.keys() == want.keys()


def test_line_matches_at_the_threshold(spark):
    words = [f"w{i}" for i in range(300)]
    lines = [words[:44], words[:34], words[:33], words[3:44], words[44:60] + words[:44], words[:22] + ["x"] + words[23:44], words[:4], words[:4], words[:5], words[:5],
             words[:6] + words[:6], words[200:204] + ["y", "z"], words[200:204] + ["y", "z"]]
    docs = [(i, "\n".join(" ".join(x) for x in lines[i::3]) + "\n\n") for i in range(3)] + [(7, None), (8, "")]
    got = {(r.doc_id, r.line) for r in line_dedup.later_matches(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.later_lines(docs).keys()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 7000), (7000, 200), (200, 200), (5, 5), (100, 7000)] + [(9000, 9000 + k) for k in range(1, 50)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 200: 100, 7000: 100, **dict.fromkeys(range(9000, 9050), 9000)}


def test_toxicity_of_held_out_rows(spark):
    big = SF_DIR.replace("sf0.001", "sf0.1")
    labels = table(spark, big, "labels").select("doc_id", "toxic")
    rows = REGISTRY["op10_toxicity"](spark, big).filter("held_out").join(labels, "doc_id").collect()
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    area = sum((a > b) + (a == b) / 2 for a in bad for b in good) / (len(bad) * len(good))
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert area > 0.9 and right > 0.93


def test_pipeline(spark, texts):
    """Stage by stage against plain versions."""
    docs = table(spark, SF_DIR, "documents")
    kept = corpus_pipeline.quality_rules(spark, docs, SF_DIR)
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    rules = {r.doc_id for r in REGISTRY["op1_quality_rules"](spark, SF_DIR).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == rules and kept.columns == docs.columns
    lines = corpus_pipeline.line_dedup_stage(spark, kept, SF_DIR)
    lines = spark.createDataFrame(lines.collect(), lines.schema)
    gone = brute.later_lines([(r.doc_id, r.text) for r in kept.collect()])
    want = {}
    for r in kept.collect():
        left = "\n".join(x for n, x in enumerate(r.text.split("\n")) if (r.doc_id, n) not in gone)
        if left.strip() or left == r.text:
            want[r.doc_id] = left
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())
    one = corpus_pipeline.near_dedup_stage(spark, lines, SF_DIR)
    one = spark.createDataFrame(one.collect(), one.schema)
    groups = brute.near_groups(list(want.items()))
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in groups.items() if i == c}
    mixed = corpus_pipeline.source_mixing(spark, one, SF_DIR)
    mixed = spark.createDataFrame(mixed.collect(), mixed.schema)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in one.collect()}
    packed = corpus_pipeline.best_fit_packing(spark, mixed, SF_DIR)
    assert Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == Counter(r.doc_id for r in mixed.collect())
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()
