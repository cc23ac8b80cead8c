"""Unsigned arithmetic and derived signals."""

import random

import pytest
from pyspark.sql import functions as F

from stepfold.functions import bits as u
from stepfold.operators.derive import derive_signal, derived_definition
from tests import models

OPS = {
    "add": (u.u_add, lambda a, b: a + b), "sub": (u.u_sub, lambda a, b: a - b), "mul": (u.u_mul, lambda a, b: a * b),
    "div": (u.u_div, lambda a, b: a // b if b else None), "mod": (u.u_mod, lambda a, b: a % b if b else None),
    "and": (u.u_and, lambda a, b: a & b), "or": (u.u_or, lambda a, b: a | b), "xor": (u.u_xor, lambda a, b: a ^ b),
    "shl": (u.u_shl, lambda a, b: a << b if b < 64 else 0), "shr": (u.u_shr, lambda a, b: a >> b if b < 64 else 0),
    "lt": (u.u_lt, lambda a, b: int(a < b)), "le": (u.u_le, lambda a, b: int(a <= b)), "gt": (u.u_gt, lambda a, b: int(a > b)),
    "ge": (u.u_ge, lambda a, b: int(a >= b)), "eq": (u.u_eq, lambda a, b: int(a == b)), "ne": (u.u_ne, lambda a, b: int(a != b)),
    "land": (u.u_land, lambda a, b: int(bool(a) and bool(b))), "lor": (u.u_lor, lambda a, b: int(bool(a) or bool(b))),
}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("width", [64, 63, 33, 8])
def test_operations(spark, width):
    rng = random.Random(width)
    top = (1 << width) - 1
    edges = [x & top for x in (0, 1, 2, 3, 63, 64, (1 << 31), (1 << 32) - 1, (1 << 62), (1 << 63) - 1, 1 << 63, (1 << 64) - 1)]
    pairs = [(a, b) for a in edges for b in edges] + [(rng.getrandbits(width), rng.getrandbits(rng.randint(1, width))) for _ in range(300)]
    df = spark.createDataFrame([(i, signed(a), signed(b)) for i, (a, b) in enumerate(pairs)], "i int, a bigint, b bigint")
    a, b = u.Bits(F.col("a"), width), u.Bits(F.col("b"), width)
    rows = df.select("i", *[f(a, b).bits.alias(n) for n, (f, _) in OPS.items()], u.u_neg(a).bits.alias("neg"),
                     u.u_inv(a).bits.alias("inv"), u.u_not(a).bits.alias("not")).collect()
    for row in rows:
        x, y = pairs[row.i]
        for name, (_, model) in OPS.items():
            want = model(x, y)
            assert row[name] == (None if want is None else signed(want & top)), (name, x, y)
        assert (row["neg"], row["inv"], row["not"]) == (signed(-x & top), signed(~x & top), int(x == 0))


def test_unknown_operands_stay_unknown(spark):
    df = spark.createDataFrame([(0,)], "a bigint").select("a", F.lit(None).cast("bigint").alias("z"))
    a, z = u.Bits(F.col("a"), 8), u.Bits(F.col("z"), 8)
    row = df.select(*[f(a, z).bits.alias(n) for n, (f, _) in OPS.items()]).first()
    assert all(v is None for v in row)


@pytest.mark.parametrize("spans", [(), (2, 2), (17, 16)])
def test_derived_signal(spark, spans):
    rng = random.Random(11)
    events = models.written(models.random_samples(rng, 3, 90, 60, values=8))
    deps = spark.createDataFrame([("t", 1, 0, 1), ("t", 1, 1, 2), ("t", 2, 0, 2), ("t", 2, 1, 3)],
                                 "trace_id string, group_id bigint, slot int, signal_id bigint")
    meta = spark.createDataFrame([("t", 10)], "trace_id string, start bigint")
    got = derive_signal(models.events_table(spark, events), deps, meta, [3, 3], lambda a, b: u.u_div(u.u_add(a, b), b), spans=spans)
    want = []
    for group, (x, y) in {1: (1, 2), 2: (2, 3)}.items():
        last = None
        for c in range(10, 60):
            (a, sa), (b, sb) = models.value(events.get(x, {}), c), models.value(events.get(y, {}), c)
            shown = (0, 1) if sa or sb or b == 0 else (((a + b) & 7) // b, 0)
            if shown != last:
                want.append((group, c, *shown))
            last = shown
    assert sorted((r.group_id, r.cycle, r.raw_bits, r.state) for r in got.collect()) == want


def test_definition():
    assert derived_definition(lambda a, b: u.u_lt(a, b), [8, 9]) == {"width": 1, "kind": "bit", "radix": "bin"}
    assert derived_definition(lambda a, b: u.u_add(a, b), [8, 9]) == {"width": 9, "kind": "bus", "radix": "hex"}
