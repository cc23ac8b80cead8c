"""A dense group of near copies with members that nearly belong to it: few rows for many candidates, and no link lost."""

import random

import numpy as np
import pyarrow as pa

from stepfold.llm import near_dedup
from tests.llm import brute


def dense(mains, strays, seed=4):
    """Copies of one text with a word changed, and others with three to four, which are about as similar as the limit asks."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    out = []
    for i in range(mains + strays):
        words = list(base)
        for at in rng.sample(range(0, 100, 6), 1 if i < mains else rng.choice([2, 3, 3, 4])):
            words[at] = f"x{i}at{at}"
        out.append((i + 1, " ".join(words)))
    return out


def sketched(docs):
    sets = list(near_dedup.shingle_sets(pa.array([t for _, t in docs])))
    return [near_dedup._minwise(s).astype(np.uint8).tobytes() for s in sets]


def test_rows_of_a_node_grow_with_its_members():
    for mains in (100, 400):
        docs = dense(mains, 30)
        label = [1] * mains + [i for i, _ in docs[mains:]]
        node = pa.table({"key": [7] * len(docs), "rep": [i for i, _ in docs], "label": label, "marks": sketched(docs)}).to_batches()
        sent = pa.Table.from_batches(near_dedup._compare(False, near_dedup.FINE, near_dedup.LEAST_FINE)(iter(node))).to_pylist()
        assert 0 < len(sent) <= len(docs) + near_dedup.FEW * 30
        members = {r["a"] for r in sent if r["b"] is None}
        assert members and len(members) == sum(r["b"] is None for r in sent)


def test_no_link_of_a_dense_group_is_lost(spark):
    docs = dense(120, 40) + [(1000 + i, t) for i, t in dense(1, 30, 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(frame).collect()}
    assert got == brute.near_groups(docs)
    assert len({c for _, c in got.values()}) > 2
