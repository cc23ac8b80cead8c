"""What the streaming jobs keep between batches: Spark's own keyed state, and the rules applied to it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stepfold.schema import HIGH_Z, KNOWN

#: Events in the life of a signal, beside its updates (no event).
ADDED, REMOVED = "added", "removed"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that arbitrary state needs, for queries started inside; a query keeps the settings it started with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


#: Neighbouring signals that share one entry of the state: 2^8 of them, so that an entry and its calls to Python don't grow with the trace.
SHARED_BITS = 8

Last = tuple[int, int, int, bool]  # cycle, raw_bits, state, alive
#: What is held of several signals: sorted ids, cycle, raw_bits, state and a flag (alive, or ended).
Held = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_TYPES = (np.int64, np.int64, np.int64, np.int8, bool)


def held(columns: Sequence[Sequence] | None) -> Held:
    return tuple(np.asarray(c, t) for c, t in zip(columns or ((),) * len(_TYPES), _TYPES))


def _of(last: Held, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each of ``ids``: whether it is held, and its values, 0 if not."""
    if not len(last[0]):
        return np.zeros(len(ids), bool), [np.zeros(len(ids), t) for t in _TYPES[1:]]
    at = np.minimum(np.searchsorted(last[0], ids), len(last[0]) - 1)
    seen = last[0][at] == ids
    return seen, [np.where(seen, c[at], c.dtype.type(0)) for c in last[1:]]


def _with(last: Held, new: Held) -> Held:
    """What is held, with the signals of ``new`` replaced or added."""
    kept = ~np.isin(last[0], new[0])
    joined = [np.append(c[kept], n) for c, n in zip(last, new)]
    order = np.argsort(joined[0], kind="stable")
    return held([c[order] for c in joined])


def _ends(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by signal: which are the first and which the last of theirs."""
    other = of[1:] != of[:-1]
    return np.append(True, other)[:len(of)], np.append(other, True)[:len(of)]


def judge_signals(rows: pd.DataFrame, last: Held, declared: bool, signal: str = "storage_id") -> tuple[pd.DataFrame, Held]:
    """Updates and events of some signals in one batch to their changes and refused rows, and their new last values.

    ``rows`` has the signal, cycle, seq, raw_bits, state, event, initial_bits and the ``reason`` why a row was refused before, if it was. Rows of a
    signal are taken by (cycle, seq). Refused are: rows at or before the last cycle of an earlier batch (late); updates while the signal isn't there, which after
    ``removed`` and, if signals are ``declared``, before ``added`` it is not (not_added); events that change nothing (already_added,
    not_added); all updates of a cycle but the last (duplicate_in_cycle). ``added`` starts the signal with its raw_bits, ``removed`` leaves it at Z. A
    signal that isn't declared starts from initial_bits, and a first value equal to it is no change.
    """
    rows = rows.iloc[np.lexsort((rows["seq"], rows["cycle"], rows[signal]))].reset_index(drop=True)
    ids, start, of = np.unique(rows[signal].to_numpy(), return_index=True, return_inverse=True)
    end = np.append(start[1:], len(rows))
    seen, (last_cycle, last_bits, last_state, last_alive) = _of(last, ids)
    cycle, reason, event = rows["cycle"].to_numpy(), rows["reason"].to_numpy(object).copy(), rows["event"].to_numpy(object)
    good = pd.isna(reason)
    late = good & seen[of] & (cycle <= last_cycle[of])
    reason[late], good[late] = "late", False
    added, removed = event == ADDED, event == REMOVED
    there, implied = seen & last_alive, ~seen & (not declared)
    update = np.flatnonzero(good & ~added & ~removed)
    first = end.copy()
    np.minimum.at(first, of[update], update)
    alive = (there | implied)[of]
    for i in np.flatnonzero(good & (added | removed)):  # events are few
        s = of[i]
        present = there[s] or (implied[s] and (removed[i] or first[s] < i))
        if bool(added[i]) == bool(present):
            reason[i], good[i] = ("already_added" if present else "not_added"), False
        else:
            there[s], implied[s] = bool(added[i]), False
            alive[i:end[s]] = there[s]
    gone = good & ~added & ~removed & ~alive
    reason[gone], good[gone] = "not_added", False
    at = np.flatnonzero(good)
    final = np.append((cycle[at][1:] != cycle[at][:-1]) | (of[at][1:] != of[at][:-1]), True)[:len(at)]
    overtaken = at[~final]
    overtaken = overtaken[~(added | removed)[overtaken]]
    reason[overtaken] = "duplicate_in_cycle"
    at = at[final]
    own = of[at]
    bits = np.where(removed, 0, rows["raw_bits"].to_numpy())[at]
    state = np.where(removed, HIGH_Z, np.where(added, KNOWN, rows["state"].to_numpy()))[at]
    head, tail = _ends(own)
    first_bits, first_state = np.where(seen, last_bits, rows["initial_bits"].to_numpy()[start]), np.where(seen, last_state, KNOWN)
    change = (bits != np.where(head, first_bits[own], np.roll(bits, 1))) | (state != np.where(head, first_state[own], np.roll(state, 1)))
    change |= head & ~seen[own] & (added[at] | declared)  # it was absent before
    if len(at):
        touched = own[tail]
        last = _with(last, (ids[touched], cycle[at][tail], bits[tail], state[tail], (there | implied)[touched]))
    rows["reason"] = reason
    found = rows.iloc[at[change]].copy()
    found["raw_bits"], found["state"], found["reason"], found["missing"] = bits[change], state[change], None, 0
    return pd.concat([found, rows[~pd.isna(reason)]]), last


def judge_updates(rows: pd.DataFrame, last: Last | None, declared: bool) -> tuple[pd.DataFrame, Last | None]:
    """As ``judge_signals``, for rows of one signal."""
    before = held(None if last is None else [[0], *[[x] for x in last]])
    out, after = judge_signals(rows.assign(storage_id=0), before, declared)
    return out, tuple(c[0].item() for c in after[1:]) if len(after[0]) else None


class _SharedState(StatefulProcessor):
    """Neighbouring signals of a trace share a value of Spark's state, which holds a row's worth for each."""

    flag: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"signal array<long>, cycle array<long>, raw_bits array<long>, state array<byte>, {self.flag} array<boolean>")

    def before(self) -> Held:
        return held(self.last.get() if self.last.exists() else None)

    def keep(self, old: Held, new: Held) -> None:
        if new is not old:
            self.last.update(tuple(c.tolist() for c in new))

    def close(self) -> None:
        pass


class LastValues(_SharedState):
    """The last value of each signal, in Spark's state; rows go out as changes (no reason) or refused (a reason)."""

    flag = "alive"

    def __init__(self, declared: bool):
        self.declared = declared

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.before()
        out, new = judge_signals(pd.concat(list(rows), ignore_index=True), last, self.declared)
        self.keep(last, new)
        yield out.assign(trace_id=key[0])[["trace_id", "storage_id", "cycle", "seq", "raw_bits", "state", "reason", "missing"]]


def close_windows(rows: pd.DataFrame, last: Held, buckets: list[int]) -> tuple[pd.DataFrame, pd.DataFrame, Held]:
    """Changes of some signals in one batch to the windows they close and the refused rows, and what stays open.

    The last change of a signal is also the last one of its open window of every size, so it is all that has to be kept. A change that lies in
    another window of some size closes the one before it; a row without state ends the signal and closes all. Refused are rows at
    or before the last cycle of an earlier batch (late), behind the end (after_end), and a second change of a cycle.
    """
    rows = rows.sort_values(["signal_id", "cycle", "ends", "state", "raw_bits"], kind="stable", ignore_index=True)
    ids, of = np.unique(rows["signal_id"].to_numpy(), return_inverse=True)
    seen, (last_cycle, last_bits, last_state, ended) = _of(last, ids)
    cycle, ends, reason = rows["cycle"].to_numpy(), rows["ends"].to_numpy(bool), rows["reason"].to_numpy(object).copy()
    good = pd.isna(reason)
    behind = good & ended[of]
    late = good & seen[of] & ~ended[of] & ((cycle < last_cycle[of]) | ((cycle == last_cycle[of]) & ~ends))
    reason[behind], reason[late] = "after_end", "late"
    good &= ~behind & ~late
    stop = np.full(len(ids), len(rows))
    np.minimum.at(stop, of[good & ends], np.flatnonzero(good & ends))
    after = good & (np.arange(len(rows)) > stop[of])
    reason[after], good[after] = "after_end", False
    over = stop < len(rows)
    at = np.flatnonzero(good & ~ends)
    again = at[:-1][(cycle[at][1:] == cycle[at][:-1]) & (of[at][1:] == of[at][:-1])]
    reason[again] = "duplicate_in_cycle"
    at = np.setdiff1d(at, again)
    still = np.flatnonzero(seen & ~ended)
    kept = pd.DataFrame({"signal_id": np.append(still, of[at]), **{c: np.append(before[still], rows[c].to_numpy()[at]) for c, before in (
        ("cycle", last_cycle), ("raw_bits", last_bits), ("state", last_state))}})
    kept = kept.sort_values(["signal_id", "cycle"], kind="stable", ignore_index=True)
    own, times = kept["signal_id"].to_numpy(), kept["cycle"].to_numpy(np.int64)
    kept["signal_id"] = ids[own]
    _, tail = _ends(own)
    closed = []
    for level, bucket in enumerate(buckets):
        window = times // bucket
        done = np.where(tail, over[own], np.append(window[1:] != window[:-1], True)[:len(window)])
        part = kept[done].copy()
        part["level"], part["window_start"] = level, window[done] * bucket
        closed.append(part)
    empty = np.setdiff1d(np.flatnonzero(over), own)  # signals that end without a change
    zero = np.zeros(len(empty), np.int64)
    if len(own) or len(empty):
        last = _with(last, (np.append(kept["signal_id"].to_numpy()[tail], ids[empty]), np.append(times[tail], cycle[stop[empty]]),
                            np.append(kept["raw_bits"].to_numpy()[tail], zero), np.append(kept["state"].to_numpy()[tail], zero),
                            np.append(over[own[tail]], over[empty])))
    rows["reason"] = reason
    return pd.concat(closed, ignore_index=True), rows[~pd.isna(reason)], last


class OpenWindows(_SharedState):
    """The last change of each signal, in Spark's state; closed windows of all sizes go out, and refused rows with a reason."""

    flag = "ended"

    def __init__(self, buckets: list[int]):
        self.buckets = buckets

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.before()
        closed, refused, new = close_windows(pd.concat(list(rows), ignore_index=True), last, self.buckets)
        self.keep(last, new)
        refused = refused.assign(level=-1, window_start=0)
        out = pd.concat([closed.assign(reason=None, missing=0), refused], ignore_index=True).assign(trace_id=key[0])
        yield out[["trace_id", "signal_id", "level", "window_start", "cycle", "raw_bits", "state", "reason", "missing"]]
