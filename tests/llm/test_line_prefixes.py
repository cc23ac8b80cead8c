"""Prefix rows of line deduplication move in pieces by range of tokens, and only those whose token two lines have come back."""

import numpy as np
import pytest

from stepfold.llm import line_dedup


@pytest.mark.parametrize("most", [line_dedup.HELD, 50])
def test_rows_that_met(spark, most):
    random = np.random.default_rng(5)
    rows = np.zeros(6_000, line_dedup._ROW)
    rows["token"] = random.integers(0, 3_000, len(rows), np.uint64) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(1 << 63)
    rows["token"][:900] = rows["token"][0]  # a token of many lines, in one range
    rows["d1"], rows["size"], rows["at"] = random.integers(-40, 40, len(rows)), 70_000, 66_000
    packed = [spark.createDataFrame(b.to_pandas(), "part int, rows binary") for k in range(0, len(rows), 1_500) for b in line_dedup._packed(rows[k:k + 1_500])]
    moved = packed[0].union(packed[1]).union(packed[2]).union(packed[3])
    assert moved.groupBy("part").count().filter("count > 4").isEmpty()
    lines = {}
    for token, d1 in zip(rows["token"].astype(np.int64).tolist(), rows["d1"].tolist(), strict=True):
        lines.setdefault(token, set()).add(d1)
    got = [tuple(r) for r in line_dedup._met(moved, most).collect()]
    assert {(t, d) for t, d, _, _ in got} == {(t, d) for t, ds in lines.items() if len(ds) > 1 for d in ds}
    assert {(s, a) for _, _, s, a in got} == {(70_000, 66_000)}
    assert most < len(rows) or len(set(got)) == len(got)
