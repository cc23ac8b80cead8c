"""Hard negatives by exact integer scores from products modulo small primes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.plans.lineage import cut

ROWS = 1 << 16  # rows of a cell at most, on average
LEAST_ROWS = 1 << 10  # a cell has no fewer while there are not PARTS cells
PARTS = 32
ANCHORS = 1 << 14  # anchors of a cell at most, on average
TILE = 256  # anchors scored at once
STRETCH = 4096  # rows scored at once
EXACT = 1 << 24  # float32 holds integers up to here
LARGEST = 1021  # primes up to here: 64 products of their residues add up to less than EXACT, one of a residue and a digit's factor to less than 2^20
MOST = 1 << 55  # scores stay below, so that a hundred of them fit into 64 bits

PAIRS = "anchor_id long, label int, other_id long, score long"


def _primes(most: int) -> list[int]:
    """Odd primes up to ``most``, largest first."""
    return [p for p in range(most, 2, -1) if p % 2 and all(p % q for q in range(3, int(p ** 0.5) + 1, 2))]


class Residues:
    """Exact products of integer matrices whose scores stay within ``bound``, by float32 products modulo small primes.

    Residues lie around zero, so a product of ``block`` columns stays below 2^24 and every partial sum is exact, in any order. Longer rows are
    multiplied block by block and reduced in between. As many primes are taken as their product needs to tell 2 * bound + 1 scores apart; the
    score is put together from its digits to those primes as radices (Garner's form of the Chinese remainder), each digit again in float32.
    """

    def __init__(self, bound: int, width: int):
        self.block = min(width, (EXACT - 1) // (LARGEST // 2) ** 2)
        self.primes: list[int] = []
        product = 1
        for p in _primes(LARGEST):
            if product > 2 * bound + 1:
                break
            self.primes.append(p)
            product *= p
        self.kind = np.int32 if bound < 1 << 30 else np.int64

    @staticmethod
    def _centred(x: np.ndarray, p: int) -> np.ndarray:
        """``x`` less its nearest multiple of p, in place; of values below 2^20 exactly the one residue around zero."""
        x -= np.float32(p) * np.rint(x * np.float32(1 / p))
        return x

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        """Residues of an integer matrix, a float32 matrix for each prime."""
        return [((x + p // 2) % p - p // 2).astype(np.float32) for p in self.primes]

    def product(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Scores of all rows of one matrix with all rows of another, both split."""
        digits: list[np.ndarray] = []
        for k, p in enumerate(self.primes):
            r = np.zeros((len(a[k]), len(b[k])), np.float32)
            for at in range(0, a[k].shape[1], self.block):
                part = self._centred(a[k][:, at:at + self.block] @ b[k][:, at:at + self.block].T, p)
                r = self._centred(r + part, p) if at else part
            r = self._centred(r, p)
            for q, digit in zip(self.primes, digits):
                turn = pow(q, -1, p)
                r -= digit
                r *= np.float32(turn - p if turn > p // 2 else turn)
                r = self._centred(self._centred(r, p), p)
            digits.append(r)
        out = digits[-1].astype(self.kind)
        for p, digit in zip(self.primes[-2::-1], digits[-2::-1]):
            out *= self.kind(p)
            out += digit.astype(self.kind)
        return out


def _first(scores: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of the best scores of each row, one of each row at a time; the leftmost of equal ones. Used ones are overwritten."""
    low = np.iinfo(scores.dtype).min
    at = np.arange(len(scores))
    for _ in range(n):
        best = scores[at].argmax(axis=1)
        some = scores[at, best] > low
        at, best = at[some], best[some]
        if not len(at):
            return
        yield at, best
        scores[at, best] = low


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(256 * x) of vectors as rows; missing last components are 0."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0) if flat.num_chunks else pa.array([], flat.type)
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(256.0 * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    out = np.zeros((len(sizes), max(1, width)), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.append(0, np.cumsum(sizes))[:-1], sizes)] = values
    return out


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def prepared(embeddings: DataFrame, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part: no null, no NaN and no infinity anywhere.

    A label moves on by one, modulo ``labels``, where ``vec_id`` is divisible by ``shift_every``. Rows with the same ``vec_id`` are one
    vector, the smallest by label and components.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    label = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("int")
    rows = embeddings.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(fine)
    one = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.alias("label"), "embedding").alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.select("vec_id", "v.label", "v.embedding")


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, run, schema: str) -> DataFrame:
    """``run(anchors, rows)`` for each cell of a grid in which every anchor meets every row once.

    A cell holds some ROWS rows and ANCHORS anchors whatever the input, so memory is bounded and work spreads evenly; rows are
    copied once for each group of anchors, anchors once for each part of the rows.
    """
    parts = max(-(-n_rows // ROWS), min(-(-n_rows // LEAST_ROWS), PARTS), 1)
    groups = max(-(-n_anchors // ANCHORS), 1)

    def dealt(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    left = anchors.withColumns({"__group": dealt("anchor_id", groups), "__part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    right = rows.withColumns({"__part": dealt("vec_id", parts), "__group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    keys, n = ["__part", "__group"], parts * groups
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInArrow(run, schema)


def mined(embeddings: DataFrame, anchor_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
          shift_every: int = 7, labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first hard negatives of anchors and positives.

    Scores are exact integer products of floor(256 * component); higher ones come first, then smaller ids. Anchors are
    the vectors with an id divisible by ``anchor_every``; their positives are the first others of the same label, their negatives for a positive
    the first ones of other labels with a score of ``low`` to ``high`` percent of its score. Which vectors take part and what
    repeated ids mean is said at ``prepared``; where lengths differ, missing components are 0. An anchor without positives, or a positive without
    negatives, has no row; an empty table gives none. Scores of 2^55 and more are an error, as the result holds 64-bit integers.

    Both searches deal anchors and rows into a grid of cells, score a cell by ``Residues`` and keep its best few; windows choose among those.
    """
    rows = cut(prepared(embeddings, shift_every, labels))
    size = F.max(F.aggregate("embedding", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(F.floor(256 * x.cast("double")).cast("double")))))
    stats = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % anchor_every == 0).alias("anchors"), F.max(F.size("embedding")).alias("width"), size.alias("size")).first()
    width, bound = stats["width"] or 1, int(stats["size"] or 0) ** 2 * (stats["width"] or 1)
    if bound >= MOST:
        raise ValueError(f"scores may reach {bound}, which 64-bit results can't hold")

    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def best_of_same(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if not left.num_rows or not right.num_rows:
            return _pairs(found)
        gemm = Residues(bound, width)
        ids, of, by = _ints(right, "vec_id"), _ints(right, "label"), _ints(left, "of")
        order = np.lexsort((ids, of))
        ids, of, x = ids[order], of[order], _matrix(right.column("embedding"), width)[order]
        anchor, a = _ints(left, "anchor_id"), _matrix(left.column("vector"), width)
        for label in np.unique(by):
            begin, end = np.searchsorted(of, [label, label + 1])
            mine = np.flatnonzero(by == label)
            for at in range(begin, end, STRETCH):
                stop = min(end, at + STRETCH)
                there = gemm.split(x[at:stop])
                for k in range(0, len(mine), TILE):
                    some = mine[k:k + TILE]
                    scores = gemm.product(gemm.split(a[some]), there)
                    kept = scores.copy()
                    scores[anchor[some][:, None] == ids[None, at:stop]] = np.iinfo(scores.dtype).min
                    for i, j in _first(scores, positives):
                        found.append((anchor[some[i]], np.full(len(i), label), ids[at + j], kept[i, j].astype(np.int64)))
        return _pairs(found)

    def best_of_others(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if not left.num_rows or not right.num_rows:
            return pa.table(_columns(found, 5), names=names)
        gemm = Residues(bound, width)
        ids = _ints(right, "vec_id")
        order = np.argsort(ids)
        ids, of, x = ids[order], _ints(right, "label")[order], _matrix(right.column("embedding"), width)[order]
        anchor, by, a = _ints(left, "anchor_id"), _ints(left, "of"), _matrix(left.column("vector"), width)
        wanted = left.column("positives").to_pylist()
        n = max(map(len, wanted), default=0)
        aim = np.full((len(anchor), n), -1, np.int64)  # a positive score below 0 has no window
        name = np.zeros((len(anchor), n), np.int64)
        for i, row in enumerate(wanted):
            for k, p in enumerate(row):
                aim[i, k], name[i, k] = p["score"], p["other_id"]
        least, most = -(-low * aim // 100), high * aim // 100
        for at in range(0, len(ids), STRETCH):
            there = gemm.split(x[at:at + STRETCH])
            for k in range(0, len(anchor), TILE):
                scores = gemm.product(gemm.split(a[k:k + TILE]), there)
                nothing = np.iinfo(scores.dtype).min
                scores[by[k:k + TILE, None] == of[None, at:at + STRETCH]] = nothing
                for p in range(n):
                    lo, hi = least[k:k + TILE, p, None], most[k:k + TILE, p, None]
                    kept = np.where((scores >= lo.astype(scores.dtype)) & (scores <= hi.astype(scores.dtype)) & (aim[k:k + TILE, p, None] >= 0), scores, nothing)
                    for i, j in _first(kept, negatives):
                        found.append((anchor[k + i], name[k + i, p], aim[k + i, p], ids[at + j], scores[i, j].astype(np.int64)))
        return pa.table(_columns(found, 5), names=names)

    anchors = rows.filter(F.col("vec_id") % anchor_every == 0).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("of"), F.col("embedding").alias("vector"))
    same = _cells(anchors, rows, stats["anchors"], stats["n"], best_of_same, PAIRS)
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "other_id"))
    first = same.withColumn("nth", nth).filter(F.col("nth") <= positives)
    of_anchor = first.groupBy("anchor_id").agg(F.collect_list(F.struct("other_id", "score")).alias("positives"))  # a few each
    searched = cut(anchors.join(of_anchor, "anchor_id"))
    others = _cells(searched, rows, stats["anchors"], stats["n"], best_of_others,
                    ", ".join(f"{c} long" for c in names))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id"))
    return (others.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def _columns(found: list[tuple], n: int) -> list[pa.Array]:
    return [pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64), pa.int64()) for k in range(n)]


def _pairs(found: list[tuple]) -> pa.Table:
    columns = _columns(found, 4)
    columns[1] = columns[1].cast(pa.int32())
    return pa.table(columns, names=["anchor_id", "label", "other_id", "score"])


OP11_SQL = """
WITH kept AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM kept a JOIN kept r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negative AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
    FROM positive p JOIN scored s USING (anchor_id)
    WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 3
"""
