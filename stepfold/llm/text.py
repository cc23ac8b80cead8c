"""Texts of an Arrow batch as bytes, and vectorised hashes of their words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS = 1000

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ROOT = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def in_batches(df: DataFrame) -> DataFrame:
    """``df`` after telling the session to send at most BATCH_ROWS rows to Python at once (a smaller setting stays)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other and the offsets of each; null counts as empty. Binary values are taken as they are."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def each_text(texts: pa.Array) -> Iterator[bytes]:
    data, at = raw(texts)
    view = data.tobytes()
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield view[begin:end]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def spans(keep: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true bytes, where runs also end at the offsets ``at``."""
    edge = np.zeros(len(keep) + 1, bool)
    edge[at] = True
    begins, ends = keep.copy(), keep.copy()
    begins[1:] &= ~keep[:-1] | edge[1:-1]
    ends[:-1] &= ~keep[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word (a run without blanks), and the number of the first word of each text and one more."""
    begins, ends = spans(~_BLANK[data], at)
    return begins, ends, np.searchsorted(begins, at)


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values, so that every bit counts."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the root and of its inverse modulo 2^64, made longer as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = 1 << (n - 1).bit_length()
            for name, root in (("up", _ROOT), ("down", pow(_ROOT, -1, 1 << 64))):
                row = np.full(m, root, np.uint64)
                row[0] = 1
                setattr(cls, name, np.cumprod(row, dtype=np.uint64))
        return cls.up, cls.down


#: Bytes hashed at once; the powers take 16 bytes each.
_STRETCH = 1 << 20


def hash_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: the same bytes give the same hash anywhere. Spans are in order, without overlap."""
    out = np.zeros(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        base = int(begins[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _STRETCH, side="right")))
        last = int(ends[j - 1])
        up, down = _Powers.of(last - base + 1)
        sums = np.zeros(last - base + 1, np.uint64)
        np.cumsum(_BYTES[data[base:last]] * up[:last - base], dtype=np.uint64, out=sums[1:])
        b, e = begins[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        i = j
    return out
