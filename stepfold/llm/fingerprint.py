"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepfold.llm.text import column, hash_spans, in_batches, mix, raw, words
from stepfold.plans.lineage import cut

CELLS = 24  # of the sketch that is the fingerprint; in HASHES tables
HASHES = 3
GROWTH = 4  # a sketch that can't be peeled is made so many times larger
BUCKET = 1024  # doc_ids that one sorted stretch of rows covers
MOST_CELLS = 1 << 21  # of all sketches held at once

_STOP = np.zeros(256, bool)
_STOP[[*b".!?"]] = True
_ONE = np.uint64(1)


def paragraph_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraphs of each text and the number of the text each belongs to.

    A paragraph ends with its line or sentence; long ones are cut after words that their own bytes choose, about one in twelve, so an
    edit changes the paragraphs that it touches only. The digest counts in how often the same bytes came before in the text.
    """
    data, at = raw(texts)
    begins, ends, first = words(data, at)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    last = data[ends - 1]
    lines = np.append(0, np.cumsum(data == 0x0A, dtype=np.int64))
    closes = _STOP[last] | ((data[begins].astype(np.int64) * 7 + last.astype(np.int64) * 31 + (ends - begins) * 13) % 12 == 0)
    closes[:-1] |= (lines[begins[1:]] > lines[ends[:-1]]) | (owner[1:] != owner[:-1])
    closes[-1] = True
    stops = np.flatnonzero(closes)
    starts = np.append(0, stops[:-1] + 1)
    keys, owner = hash_spans(data, begins[starts], ends[stops]), owner[stops]
    order = np.lexsort((keys, owner))
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    run = np.arange(len(keys)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))
    again = np.empty(len(keys), np.uint64)
    again[order] = run
    return mix(keys + again * np.uint64(0x9E3779B97F4A7C15)), owner


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0x5851F42D4C957F2D))


def _places(keys: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """The HASHES cells of each key in the flat table of all owners."""
    each = cells // HASHES
    out = np.empty((HASHES, len(keys)), np.int64)
    for j in range(HASHES):
        h = mix(keys + np.uint64((0xA24BAED4963EE407 * (cells + j)) & (2**64 - 1)))
        out[j] = owner * cells + j * each + (h % np.uint64(each)).astype(np.int64)
    return out


def sketch(keys: np.ndarray, owner: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of ``n`` owners, ``cells`` cells: how many keys, their exclusive or, and that of their check values."""
    count, key, check = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    checks = _check(keys)
    for place in _places(keys, owner, cells):
        count += np.bincount(place, minlength=n * cells)
        np.bitwise_xor.at(key, place, keys)
        np.bitwise_xor.at(check, place, checks)
    return count, key, check


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``n`` differences of sketches: how many keys are recovered, and whether those are all."""
    found = np.zeros(n, np.int64)
    while True:
        pure = np.flatnonzero((np.abs(count) == 1) & (check == _check(key)))
        if not len(pure):
            break
        owner = pure // cells
        _, one = np.unique(mix(key[pure] + owner.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)), return_index=True)
        keys, owner, sign = key[pure[one]], owner[one], count[pure[one]]
        found += np.bincount(owner, minlength=n)
        for place in _places(keys, owner, cells):
            np.subtract.at(count, place, sign)
            np.bitwise_xor.at(key, place, keys)
            np.bitwise_xor.at(check, place, _check(keys))
    done = ((count == 0) & (key == 0)).reshape(n, cells).all(axis=1)
    return found, done


def _part(keys: np.ndarray, owner: np.ndarray, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the owners ``which``, numbered from 0."""
    new = np.full(n, -1)
    new[which] = np.arange(len(which))
    take = new[owner] >= 0
    return keys[take], new[owner[take]]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Jaccard similarity of the paragraphs of ``n`` pairs, from the peeled differences of their sketches; 1 if both are empty."""
    n_a, n_b = np.bincount(a[1], minlength=n), np.bincount(b[1], minlength=n)
    differing = np.zeros(n, np.int64)
    left, cells = np.arange(n), CELLS
    while len(left):
        failed = []
        step = max(1, MOST_CELLS // cells)
        for i in range(0, len(left), step):
            which = left[i:i + step]
            x, y = (sketch(*_part(*side, n, which), len(which), cells) for side in (a, b))
            found, done = peel(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2], len(which), cells)
            differing[which[done]] = found[done]
            failed.append(which[~done])
        left, cells = np.concatenate(failed), cells * GROWTH
    total = n_a + n_b
    return np.where(total > 0, (total - differing) / np.maximum(total + differing, 1), 1.0)


def written(keys: np.ndarray, owner: np.ndarray, n: int) -> list[str]:
    """The sketch of each text as a string: its number of paragraphs, then count, key and check of each cell."""
    count, key, check = sketch(keys, owner, n, CELLS)
    rows = np.zeros((n, CELLS), [("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
    rows["count"], rows["key"] = count.reshape(n, CELLS), key.reshape(n, CELLS)
    rows["check"] = (check & np.uint64(0xFFFFFFFF)).reshape(n, CELLS)
    sizes = np.bincount(owner, minlength=n)
    return [f"{size:x}." + base64.b64encode(row.tobytes()).decode() for size, row in zip(sizes.tolist(), rows, strict=True)]


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``, or all."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows in buckets of doc_ids, in order; the first row of the next bucket stands last in each, marked ``extra``.

    A null doc_id comes before all others; equal ids follow their texts. The bucket after the last is the first.
    """
    bucket = F.floor(F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))) / BUCKET).cast("long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), bucket.alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("no_id"))
    # The bucket before each: within spans of buckets, then between the few spans.
    spans = heads.withColumn("span", F.floor(F.col("bucket") / BUCKET / 16))
    ends = spans.groupBy("span").agg(F.max("bucket").alias("top"))
    whole = Window.orderBy("span")
    ends = ends.select("span", F.coalesce(F.lag("top").over(whole), F.max("top").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before_span"))
    before = F.lag("bucket").over(Window.partitionBy("span").orderBy("bucket"))
    placed = spans.withColumn("before", before).join(ends, "span")
    # Written first, so that Spark knows how small it is before it plans to move the texts.
    placed = cut(placed.select(F.when(~F.col("no_id"), F.col("head")).alias("head"), F.coalesce("before", "before_span").alias("bucket")))
    first = rows.select("doc_id", "text").join(placed, F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", "bucket", F.lit(1).alias("extra"))
    both = rows.select("doc_id", "text", "bucket", F.lit(0).alias("extra")).union(first)
    return both.repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are to each other and to the next document's.

    The edited text has its last quarter replaced from the next document in doc_id order (see ``_with_next``). A null text is
    empty; a single document is its own next. A fingerprint is the smallest sketch of the text; likeness subtracts sketches of both
    sides and peels the differing digests, with larger sketches until that succeeds, so it is exact. Repeated rows get a row each.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        """``rows``: (bucket, extra, doc_id, text) in order; one more than there are results, or more where buckets change."""
        at = [i for i in range(len(rows) - 1) if not rows[i][1]]
        texts = [row[3] for row in rows]
        changed = [edited(texts[i], texts[i + 1]) for i in at]
        keys, owner = paragraph_keys(pa.array(texts, pa.string()))
        new = paragraph_keys(pa.array(changed, pa.string()))
        n, here = len(at), np.array(at, np.int64)
        own = _part(keys, owner, len(texts), here)
        following = _part(keys, owner, len(texts), here + 1)
        prints, new_prints = written(*own, n), written(*new, n)
        columns = [[rows[i][2] for i in at], [len(texts[i]) for i in at], [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                   prints, new_prints, likeness(own, new, n), likeness(own, following, n)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*[column(batch, c).to_pylist() for c in ("bucket", "extra", "doc_id", "text")], strict=True):
                rows.append(row)
                size += len(row[3])
                if len(rows) > 256 or size > 4_000_000 and len(rows) > 1:
                    yield out(rows)
                    rows, size = rows[-1:], 0
        if len(rows) > 1:
            yield out(rows)

    return in_batches(_with_next(docs)).mapInArrow(run, FINGERPRINTS)
