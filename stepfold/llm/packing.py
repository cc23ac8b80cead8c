"""Best-fit packing of documents into sequences with several capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.text import column, each_text, in_batches
from stepfold.llm.tokens import word_encoder
from stepfold.plans.lineage import cut

#: Pieces that one task packs together. Every group leaves a few sequences half empty, so larger groups waste less.
GROUP = 16_384

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """The token ids of each text and ``end_id``, cut into pieces of ``capacity``; only longer documents are cut.

    A null or empty text is one piece that holds ``end_id`` alone. Repeated rows give repeated pieces. ``ids`` holds the ids as
    little-endian unsigned 32-bit bytes if ``keep_ids``; ``ids_crc32`` is their checksum. ``salt`` spreads repeated rows.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n = word_encoder(tokenizer), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), each_text(column(batch, "text")), strict=True):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    n += 1
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), n, *([part] if keep_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types),
                                                                                   types, strict=True)], names=names)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if keep_ids else [])]
    schema = PIECES + (", ids binary" if keep_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return in_batches(docs.select("doc_id", "text")).mapInArrow(cut_up, schema)


def best_fit(lengths: np.ndarray, capacity: int, max_documents: int, max_cost: int, rule: str = "norm",
             weights: tuple[float, float, float] = (1.0, 0.001, 0.001)) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and its place there. Items are placed by falling length.

    An item asks for tokens, for one document and for attention cost (its length squared). Of the bins that
    have all three left, ``norm`` takes the one whose residual would be the shortest vector, ``dot`` the one whose residual has the
    largest product with what the item asks; both in shares of the capacities, weighted. Ties go to the oldest bin.
    """
    full = np.array([capacity, max_documents, max_cost], float)
    w = np.asarray(weights, float)[:, None]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = lengths.min(initial=capacity)
    left = np.empty((3, 64))  # of the open bins
    names = np.empty(64, np.int64)
    open_, made = 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        ask = np.array([n, 1.0, float(n) * n])[:, None]
        at = -1
        if open_:
            room = left[:, :open_]
            fits = np.flatnonzero((room >= ask).all(axis=0))
            if len(fits):
                after = room[:, fits] - ask
                if rule == "norm":
                    score = (w * (after / full[:, None]) ** 2).sum(axis=0)
                else:
                    score = -(w * (ask / full[:, None]) * (room[:, fits] / full[:, None])).sum(axis=0)
                at = int(fits[np.argmin(score)])
        if at < 0:
            if open_ == left.shape[1]:
                left, names = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([names, np.empty_like(names)])
            at, names[open_] = open_, made
            left[:, at] = full
            open_, made = open_ + 1, made + 1
        bins[i], offsets[i] = names[at], capacity - left[0, at]
        left[:, at] -= ask[:, 0]
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < least * least:  # nothing fits any more
            left[:, at:open_ - 1], names[at:open_ - 1] = left[:, at + 1:open_].copy(), names[at + 1:open_].copy()
            open_ -= 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, max_documents: int = 2048, max_cost: int = 2048 * 2048,
         end_id: int = 0, rule: str = "norm", group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents with the sequence that holds each and its place there.

    Texts are tokenized where they are read; only the pieces' lengths move. They are dealt at random into groups of about ``group``
    pieces, whose number follows the input, and each group is packed by itself. Every sequence keeps to all three capacities; a
    piece that exceeds ``max_cost`` by itself is an error. Empty input gives no rows; nulls in ``doc_id`` are kept.
    """
    if capacity * capacity > max_cost:
        raise ValueError("a full piece must fit into max_cost")
    parts = cut(pieces(docs, tokenizer, capacity, end_id, keep_ids))
    groups = parts.count() // group + 1
    more = ["ids"] if keep_ids else []

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "salt"], ascending=[False, True, True, True], ignore_index=True)
        bins, rows["offset"] = best_fit(rows["length"].to_numpy(np.int64), capacity, max_documents, max_cost, rule)
        rows["sequence_id"] = rows["group"].to_numpy(np.int64) * (1 << 40) + bins
        return rows[[c.split()[0] for c in PLACED.split(", ")] + more]

    dealt = parts.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(place, PLACED + (", ids binary" if keep_ids else ""))
