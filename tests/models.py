"""Slow, obvious answers on small traces: every question is asked cycle by cycle."""

from __future__ import annotations

import random

EVENT = "trace_id string, signal_id bigint, cycle bigint, raw_bits bigint, state tinyint"
SAMPLE = "trace_id string, signal_id bigint, cycle bigint, seq bigint, raw_bits bigint, state tinyint"
ABSENT = (0, 2)


def random_samples(rng: random.Random, signals: int, writes: int, cycles: int, values: int = 3) -> list[tuple]:
    """Writes in random order; one signal gets about half of them, and cycles repeat."""
    rows = []
    for seq in range(writes):
        signal = 1 if rng.random() < 0.5 else rng.randint(1, signals)
        state = 1 if rng.random() < 0.2 else 0
        rows.append(("t", signal, rng.randrange(cycles), seq, 0 if state else rng.randrange(values), state))
    rng.shuffle(rows)
    return rows


def written(rows: list[tuple]) -> dict[int, dict[int, tuple]]:
    """signal -> cycle -> (bits, state) of the last write."""
    out: dict[int, dict[int, tuple]] = {}
    for _, signal, cycle, _seq, bits, state in sorted(rows, key=lambda r: r[3]):
        out.setdefault(signal, {})[cycle] = (bits, state)
    return out


def value(events: dict[int, tuple], cycle: int) -> tuple:
    """What a step function shows at a cycle."""
    before = [c for c in events if c <= cycle]
    return events[max(before)] if before else ABSENT


def changes(events: dict[int, tuple], cycles: int) -> list[tuple]:
    """(cycle, bits, state) at each cycle whose value differs from the cycle before."""
    shown = [value(events, c) for c in range(-1, cycles)]
    return [(c, *shown[c + 1]) for c in range(cycles) if shown[c + 1] != shown[c]]


def runs(flags: list[bool], start: int) -> list[tuple[int, int]]:
    """Half-open stretches of true flags, the first flag being that of ``start``."""
    out = []
    for i, flag in enumerate(flags):
        if flag and out and out[-1][1] == start + i:
            out[-1] = (out[-1][0], start + i + 1)
        elif flag:
            out.append((start + i, start + i + 1))
    return out


def events_table(spark, events: dict[int, dict[int, tuple]], schema: str = EVENT, trace: str = "t"):
    return spark.createDataFrame([(trace, s, c, *v) for s, es in events.items() for c, v in es.items()], schema)
