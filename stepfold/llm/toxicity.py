"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more?"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.text import column, each_text, in_batches

#: Labelled documents that dictionaries and thresholds are fitted on, the smallest by hash of their ids; a row of it is 16 bytes.
SAMPLE = 16_000
#: Of them, one in so many is kept for the thresholds.
CALIBRATION = 4
FIGURES = 5  # of a text
WINDOW = 8  # words
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 8_192  # of the dictionaries
BEGINNINGS = (5, 6, 7, 8)  # bytes of words that count as well, as languages build words from stems
LEAST_EVIDENCE = 20.0  # likelihood ratio statistic of a word of the toxic dictionary
LEAST_RATIO = 8.0  # how much more often it stands in toxic text

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Model:
    """Both dictionaries, and the weights of a text's figures: bias, largest gain, sum of gains, that in proportion to the text, its length."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(compression_level=6, min_match=5, strategy=zstandard.STRATEGY_LAZY, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                                                 write_content_size=False, write_checksum=False, write_dict_id=False)
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=params)


def windows(text: bytes) -> Iterator[bytes]:
    """WINDOW words each, in lower case, with single blanks around them; every word of the text is in one."""
    words = _WORD.findall(text.lower())
    for i in range(0, len(words), WINDOW):
        yield b" " + b" ".join(words[i:i + WINDOW]) + b" "


def gains(texts: pa.Array, ordinary: bytes, toxic: bytes) -> Iterator[tuple[int, int, int]]:
    """Of each text, the largest number of bytes that the toxic dictionary saves in a window, the sum of what it saves, and the number of windows."""
    a, b = _compressor(ordinary), _compressor(toxic)
    for text in each_text(texts):
        most = total = n = 0
        for window in windows(text):
            n += 1
            gain = len(a.compress(window)) - len(b.compress(window))
            if gain > 0:
                total += gain
                most = max(most, gain)
        yield most, total, n


def _figures(found: np.ndarray) -> np.ndarray:
    """What the weights apply to, from rows of ``gains``: an array of FIGURES columns."""
    most, total, n = found.T
    return np.stack([np.ones(len(found)), np.minimum(most, 16) / 4.0, np.log1p(total), np.log1p(16.0 * total / np.maximum(n, 1)), np.log1p(n) / 4.0], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.1) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _support(texts: DataFrame) -> DataFrame:
    """(word, t, o): how many different words stand before a word, or a beginning of words, in texts of either kind.

    Copies of a text repeat its pairs of words, so a family of near copies supports its words once.
    """
    schema = pa.schema([("toxic", pa.int32()), ("before", pa.binary()), ("word", pa.binary())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, bytes, bytes]] = set()
            for toxic, text in zip(column(batch, "toxic").to_pylist(), each_text(column(batch, "text")), strict=True):
                words = _WORD.findall(text.lower())
                for a, b in zip([b"", *words], words):
                    found.update((toxic, a, b[:n]) for n in (*BEGINNINGS, len(b)) if n <= len(b))
            rows = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    rows = in_batches(texts).mapInArrow(pairs, "toxic int, before binary, word binary").distinct()
    return rows.groupBy("word").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") == 0, 1)).alias("o"))


def _content(words: list[bytes], size: int) -> bytes:
    """Words up to ``size`` bytes, the first ones last, where a match is cheapest."""
    out: list[bytes] = []
    for word in words:
        size -= len(word) + 1
        if size < 0:
            break
        out.append(b" " + word)
    return b"".join(reversed(out))


def dictionaries(texts: DataFrame) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary, trained on (text, toxic).

    The ordinary one holds the words with most support in ordinary text. The toxic one holds them, too, and before them the words that
    toxic text has significantly more of, so it can only shorten a window by those. At most as many words as fit reach the driver.
    """
    support = _support(texts).persist()
    n = support.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    n_t, n_o = float(n["t"] or 0), float(n["o"] or 0)
    common = support.filter("o > 1").orderBy(F.col("o").desc(), "word").limit(ORDINARY_BYTES // 4).select("word").collect()
    toxic: list = []
    if n_t and n_o:
        share = (F.col("t") + F.col("o")) / (n_t + n_o)
        evidence = 2 * (F.col("t") * F.log(F.col("t") / (n_t * share)) + F.when(F.col("o") > 0, F.col("o") * F.log(F.col("o") / (n_o * share))).otherwise(0.0))
        more = F.col("t") * n_o > LEAST_RATIO * n_t * F.col("o")
        scored = support.filter((F.col("t") > 1) & more).withColumn("evidence", evidence).filter(F.col("evidence") > LEAST_EVIDENCE)
        toxic = scored.orderBy(F.col("evidence").desc(), "word").limit(TOXIC_BYTES // 4).select("word").collect()
    support.unpersist()
    base = _content([bytes(r["word"]) for r in common], ORDINARY_BYTES) + b" "
    return base, _content([bytes(r["word"]) for r in toxic], TOXIC_BYTES) + base


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (doc_id, toxic), those of which the caller lets it see.

    Fitted on the ``sample`` labelled documents with the smallest hashes of their ids, whose ids are broadcast; three in four of them
    train the dictionaries, the others the weights. Rows without label or text teach nothing. Without both kinds of
    rows the dictionaries are equal and every score is the share of toxic ones, 0.5 without any.
    """
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(order, "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    held = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(CALIBRATION)) == 0
    ordinary, toxic = dictionaries(texts.filter(~held).select("text", "toxic"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array(list(gains(column(batch, "text"), ordinary, toxic)), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([column(batch, "toxic"), *map(pa.array, found.T)], names=["toxic", "most", "total", "windows"])

    seen = in_batches(texts.filter(held).select("text", "toxic")).mapInArrow(measure, "toxic int, most long, total long, windows long").collect()  # sample / CALIBRATION rows
    found, y = np.array([tuple(r)[1:] for r in seen], float).reshape(-1, 3), np.array([r["toxic"] for r in seen], float)
    if not len(seen) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(ordinary, ordinary, (math.log(share / (1 - share)), *[0.0] * (FIGURES - 1)))
    return Model(ordinary, toxic, _fit(_figures(found), y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of each row: from the gains of all windows of its whole text.

    A null or empty text has no windows, so no gains, and gets the score of that. Repeated rows get the same score each; no other
    column is looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array(list(gains(column(batch, "text"), model.ordinary, model.toxic)), float).reshape(-1, 3)
            score = 1 / (1 + np.exp(-(_figures(found) @ np.array(model.weights))))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], schema=schema)

    return in_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double, predicted int")
