"""Line deduplication by an exact set similarity join of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.tables import settle
from stepfold.llm.text import column, hash_spans, in_batches, lowered, mix, raw, words
from stepfold.llm.tokens import forget

WIDTH = 5  # words of a token; lines with fewer match by digest only
BUCKETS = 1 << 20  # of tokens, when their frequencies are counted: a table of ranks of 1 MiB whatever the input
RANGE = 1 << 16  # of them are added up together
LEAST_MARKS, MOST_MARKS = 20, 28  # of lines whose sets are compared, as powers of two: 32 MiB at most
SEEN = 200_000  # lines that a task remembers, so as to send a repeated line's tokens once
RANGES = 1 << 12  # of tokens, by their first bits: what a prefix row is packed by
PACKED = 1 << 19  # prefix rows that a task packs at once
HELD = 1 << 21  # of a range, that a task looks at together

_RANDOM = np.random.Generator(np.random.PCG64(23))
_STEPS = _RANDOM.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
_TO_RANGE = np.uint64(64 - RANGES.bit_length() + 1)
_ROW = np.dtype([("token", "<u8"), ("d1", "<i8"), ("size", "<i4"), ("at", "<i4")])
_TURN, _TURN2 = (_RANDOM.integers(1, 2**63, 2, dtype=np.uint64) | np.uint64(1))


class Lines:
    """The lines of a batch that have ``shortest`` words: A-Z in lower case, words between blanks."""

    def __init__(self, texts: pa.Array, shortest: int = WIDTH):
        data, at = raw(texts)
        data = lowered(data)
        begins, ends, _ = words(data, at)
        self.hashes = hash_spans(data, begins, ends)
        breaks = np.concatenate([[0], np.cumsum(data == 0x0A, dtype=np.int64)])
        top = breaks[at[:-1]] + np.arange(len(at) - 1)  # the number of each text's first line; a text's end ends a line
        self.n_lines = np.diff(np.append(breaks[at[:-1]], breaks[-1])) + 1
        of_word = breaks[begins] + np.searchsorted(at, begins, side="right") - 1
        first = np.flatnonzero(np.concatenate([[True], of_word[1:] != of_word[:-1]])) if len(of_word) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(of_word)))
        keep = size >= shortest
        self.first, self.size = first[keep], size[keep]
        number = of_word[self.first]
        self.text = np.searchsorted(top, number, side="right") - 1
        self.line = number - top[self.text]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit digests of the words of each line, in order."""
        if not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = np.arange(len(self.hashes), dtype=np.uint64)
        line_at = np.zeros(len(self.hashes), np.uint64)
        line_at[self.first] = self.first
        inside -= np.maximum.accumulate(line_at)
        # Words of lines that are too short lie between the lines, so each sum ends where its line does.
        edges = np.stack([self.first, self.first + self.size], axis=1).ravel()
        out = []
        for turn in (_TURN, _TURN2):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.hashes + inside * turn), dtype=np.uint64)])
            out.append(mix(sums[edges[1::2]] - sums[edges[::2]]).view(np.int64))
        return out[0], out[1]

    def _hashed(self, at: np.ndarray) -> np.ndarray:
        """The tokens that begin at these words."""
        token = self.hashes[at] * _STEPS[0]
        for k in range(1, WIDTH):
            token += self.hashes[at + k] * _STEPS[k]
        return mix(token)

    def _places(self, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens of the lines ``take`` begin, and how many each has."""
        sizes = np.maximum(self.size[take] - WIDTH + 1, 0)
        starts = np.append(0, np.cumsum(sizes))
        return np.arange(starts[-1]) - np.repeat(starts[:-1] - self.first[take], sizes), sizes

    def counts(self) -> np.ndarray:
        """Tokens of all lines by bucket."""
        at, _ = self._places(np.arange(len(self.first)))
        return np.bincount((self._hashed(at) >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)

    def tokens(self, rank: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens of the lines ``take`` in their global order, where each line's begin, and how many it has.

        A token is WIDTH words in a row. The order is by the frequency rank of a token's bucket, then by hash.
        """
        at, sizes = self._places(take)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(len(take), np.int64), np.zeros(len(take), np.int64)
        token, line = self._hashed(at), np.repeat(np.arange(len(take), dtype=np.uint64), sizes)
        rarity = rank[(token >> np.uint64(44)).astype(np.int64)].astype(np.uint64)
        packed = (line << np.uint64(40)) | (rarity << np.uint64(32)) | (token >> np.uint64(32))
        order = np.argsort(packed)
        token, line = token[order], line[order].astype(np.int64)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        token, line = token[new], line[new]
        count = np.bincount(line, minlength=len(take))
        return token, np.append(0, np.cumsum(count))[:-1], count


def _record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _occurrences(docs: DataFrame) -> DataFrame:
    """A row per line with a word (doc_id, line, d1, d2), and per task the counts of tokens by bucket (line: the range, counts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            lines = Lines(column(batch, "text"), 1)
            counts += lines.counts()
            d1, d2 = lines.digests()
            ids = column(batch, "doc_id").take(pa.array(lines.text, pa.int64()))
            yield _record(schema, [ids, lines.line.astype(np.int32), d1, d2, pa.nulls(len(d1), pa.binary())])
        for k in range(0, BUCKETS, RANGE):
            if (part := counts[k:k + RANGE]).any():
                yield _record(schema, [[None], [k // RANGE], [None], [None], [pa.compress(part.tobytes(), codec="zstd", asbytes=True)]])

    return in_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, line int, d1 long, d2 long, counts binary")


def _ranks(rows: DataFrame) -> np.ndarray:
    """Frequencies of all buckets as ranks from 0 (rarest) to 255. Each range is added up in a task; BUCKETS bytes at most reach the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, value in zip(column(batch, "line").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(pa.decompress(value, 8 * RANGE, codec="zstd", asbytes=True), np.int64)
        ranks = [np.minimum(255, np.log2(v + 1.0) * 6).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], names=["line", "counts"])

    out = np.zeros(BUCKETS, np.uint8)
    for r in rows.filter("counts IS NOT NULL").select("line", "counts").repartition(BUCKETS // RANGE, "line").mapInArrow(add, "line int, counts binary").collect():
        out[r["line"] * RANGE:(r["line"] + 1) * RANGE] = np.frombuffer(r["counts"], np.uint8)
    return out


def _packed(prefixes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, rows): rows of _ROW as one piece for each range of tokens that has some."""
    for k in range(0, len(prefixes), PACKED):
        rows = prefixes[k:k + PACKED]
        rows = rows[np.argsort(rows["token"])]
        edges = np.append(np.searchsorted(rows["token"], np.arange(RANGES, dtype=np.uint64) << _TO_RANGE), len(rows))
        parts = np.flatnonzero(np.diff(edges))
        offsets = (np.append(edges[parts], len(rows)) * _ROW.itemsize).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pieces], names=["part", "rows"])


def _prefixes(docs: DataFrame, rank: np.ndarray, percent: int) -> DataFrame:
    """(part, rows): the prefix of each line's ordered tokens as rows (token, d1, size, at), packed by range of tokens; similar lines share at least one of theirs.

    A set of n tokens with a partner of Jaccard ``percent`` shares at least ceil(percent * n) of them, so one of the first
    n - ceil(percent * n) + 1. Up to two tokens, only an equal set is similar enough, and equal lines are found by digest; but
    sets of them may also be equal without the lines being so, hence they are sent, too. Most tokens are no other line's,
    so their rows move in pieces and are never rows of a table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank)  # BUCKETS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[tuple[int, int]] = set()
        waiting, n = [], 0
        for batch in batches:
            lines = Lines(column(batch, "text"))
            d1, d2 = lines.digests()
            if len(seen) > SEEN:
                seen.clear()
            take = []
            for i, key in enumerate(zip(d1.tolist(), d2.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    take.append(i)
            take = np.array(take, np.int64)
            token, begin, count = lines.tokens(shared.value, take)
            length = count - (percent * count + 99) // 100 + 1
            each = np.append(0, np.cumsum(length))
            inside = np.arange(each[-1]) - np.repeat(each[:-1], length)
            rows = np.empty(len(inside), _ROW)
            rows["token"], rows["d1"] = token[np.repeat(begin, length) + inside], np.repeat(d1[take], length)
            rows["size"], rows["at"] = np.repeat(count, length), inside
            waiting.append(rows)
            n += len(rows)
            if n >= PACKED:
                yield from _packed(np.concatenate(waiting))
                waiting, n = [], 0
        if n:
            yield from _packed(np.concatenate(waiting))

    return in_batches(docs.select("text")).mapInArrow(run, "part int, rows binary")


def _runs(token: np.ndarray) -> np.ndarray:
    """Which of the ordered tokens stand more than once."""
    same = token[1:] == token[:-1]
    return np.append(False, same) | np.append(same, False) if len(token) else np.zeros(0, bool)


def _split(rows: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of tokens that two lines have, or that are ``known``, once per token and line; and the other rows."""
    rows = rows[np.argsort(rows["token"])]
    several = _runs(rows["token"])
    if len(known):
        several |= np.isin(rows["token"], known)
    some, alone = rows[several], rows[~several]
    some = some[np.lexsort((some["d1"], some["token"]))]
    some = some[np.append(True, (some["token"][1:] != some["token"][:-1]) | (some["d1"][1:] != some["d1"][:-1]))[:len(some)]]
    met = _runs(some["token"])
    if len(known):
        met |= np.isin(some["token"], known)
    return some[met], np.concatenate([alone, some[~met]])


def _met(prefixes: DataFrame, most: int = HELD) -> DataFrame:
    """The rows whose token another line has, too, once per token and line.

    A range of tokens is looked at as a whole. When more than ``most`` of its rows wait, those that have met go on and only their tokens are
    kept, so rows that wait are of lines that met none; such a token may send a line twice.
    """
    schema = pa.schema([("token", pa.int64()), ("d1", pa.int64()), ("size", pa.int32()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        none = np.zeros(0, np.uint64)
        held, n, last, known = [], 0, None, none  # of the last range so far

        def shown(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(rows), PACKED):
                part = rows[k:k + PACKED]
                yield _record(schema, [np.ascontiguousarray(part["token"]).view(np.int64), *[np.ascontiguousarray(part[c]) for c in ("d1", "size", "at")]])

        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = raw(column(batch, "rows"))
            rows, parts = np.frombuffer(data, _ROW), column(batch, "part").to_numpy()
            # Pieces come by range, so all of the ranges before the batch's last one are there.
            done = int(at[np.searchsorted(parts, parts[-1])]) // _ROW.itemsize
            if last != parts[-1]:
                yield from shown(_split(np.concatenate([*held, rows[:done]]), known)[0])
                held, n, last, known = [], 0, parts[-1], none
            held.append(rows[done:].copy())
            n += len(held[-1])
            if n > most:
                found, rest = _split(np.concatenate(held), known)
                yield from shown(found)
                held, n, known = [rest], len(rest), np.union1d(known, found["token"])
        if n:
            yield from shown(_split(np.concatenate(held), known)[0])

    return in_batches(prefixes.repartition("part").sortWithinPartitions("part")).mapInArrow(run, "token long, d1 long, size int, at int")


def _place(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Where each row of whole numbers stands in a table of 2^bits marks."""
    out = np.zeros(len(columns[0]), np.uint64)
    for values in columns:
        out = mix(out ^ values.astype(np.int64).view(np.uint64))
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def _marked(columns: list[np.ndarray], marks: np.ndarray, bits: int) -> np.ndarray:
    at = _place(columns, bits)
    return marks[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _whole(batch: pa.RecordBatch | pa.Table, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _marks(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A table of bits in which those of ``rows``, whose columns are whole numbers, are set: 64 bits for each row, from 2^LEAST_MARKS to 2^MOST_MARKS.

    Its parts are made in tasks, each from the rows whose marks it holds; 32 MiB at most reach the driver.
    """
    bits = min(MOST_MARKS, max(LEAST_MARKS, (64 * rows.count()).bit_length() - 1))
    schema = pa.schema([("part", pa.int64()), ("at", pa.int32())])
    names = rows.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_place(_whole(batch, names), bits))
            yield _record(schema, [at >> LEAST_MARKS, (at & ((1 << LEAST_MARKS) - 1)).astype(np.int32)])

    def pack(table: pa.Table) -> pa.Table:
        part = np.zeros(1 << LEAST_MARKS, bool)
        part[table.column("at").to_numpy()] = True
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (LEAST_MARKS - 3)
    for r in rows.mapInArrow(place, "part long, at int").groupBy("part").applyInArrow(pack, "part long, bits binary").collect():
        out[r["part"] * size:(r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def _marked_lines(doc_ids: pa.Array, texts: pa.Array, marks: np.ndarray, bits: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of texts that are marked, each as a text of its own, with their doc_ids and numbers; only these are cut into words."""
    data, at = raw(texts)
    ends = np.flatnonzero(data == 0x0A)
    n = np.bincount(np.searchsorted(at, ends, side="right") - 1, minlength=len(at) - 1) + 1  # lines of each text
    begins = np.sort(np.concatenate([at[:-1], ends + 1]), kind="stable")  # an empty text, and what follows a last line end, is a line, too
    ends = np.sort(np.concatenate([ends, at[1:]]), kind="stable")
    text = np.repeat(np.arange(len(at) - 1), n)
    line = np.arange(len(begins)) - np.repeat(np.cumsum(n) - n, n)
    ids = doc_ids.to_numpy(zero_copy_only=False)[text]
    took = np.flatnonzero(_marked([ids, line], marks, bits))
    cut = pa.array([data[b:e].tobytes() for b, e in zip(begins[took].tolist(), ends[took].tolist(), strict=True)], pa.binary()).cast(pa.string())
    return cut, ids[took], line[took]


def _token_sets(docs: DataFrame, chosen: DataFrame, rank: np.ndarray) -> DataFrame:
    """(d1, d2, own, doc_id, line): all tokens of the chosen lines (doc_id, line), worked out where the texts are read.

    The chosen lines are marked in a table of bits, so no text moves. A few others that share a mark are among the result; with far more chosen lines
    than marks, most lines are.
    """
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("own", pa.list_(pa.int64())), ("doc_id", pa.int64()), ("line", pa.int32())])
    marks, bits = _marks(chosen)
    shared = docs.sparkSession.sparkContext.broadcast((rank, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, marks = shared.value
        for batch in batches:
            texts, ids, numbers = _marked_lines(column(batch, "doc_id"), column(batch, "text"), marks, bits)
            lines = Lines(texts)
            take = np.arange(len(lines.first))
            token, begin, count = lines.tokens(rank, take)
            d1, d2 = lines.digests()
            own = pa.ListArray.from_arrays(pa.array(np.append(begin, len(token)).astype(np.int32)), pa.array(token.view(np.int64)))
            yield _record(schema, [d1, d2, own, ids[lines.text], numbers[lines.text].astype(np.int32)])

    return in_batches(docs.select("doc_id", "text")).mapInArrow(run, "d1 long, d2 long, own array<bigint>, doc_id long, line int")


def _enough(percent: int):
    """Length and position filters of two ordered sets that share a token at __at and at."""
    low, high = F.least("size", "__size"), F.greatest("size", "__size")
    least = F.ceil(F.lit(percent) * (F.col("size") + F.col("__size")) / (100 + percent))
    rest = F.least(F.col("size") - F.col("at"), F.col("__size") - F.col("__at"))
    return (100 * low >= percent * high) & (rest + F.least("at", "__at") >= least)


def _named(rows: DataFrame, names: DataFrame, key: str, there: bool = True) -> DataFrame:
    """The ``rows`` whose ``key`` is marked by ``names``, a few others with them; not ``there``: those that are surely not among the names."""
    marks, bits = _marks(names)
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(_whole(batch, [key]), shared.value, bits) == there))

    return in_batches(rows).mapInArrow(run, rows.schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(d1, d2, match): the lines (doc_id, line) whose sets are similar; pairs (d1, other) come by first digests, and all lines that have one are compared.

    Only the sets that a side of the pairs names, by marks, move to it.
    """
    first = pairs.join(_named(sets, pairs.select("d1"), "d1").select("d1", "d2", F.col("own").alias("__a")), "d1")
    others = _named(sets, pairs.select("other"), "d1").select(F.col("d1").alias("other"), F.struct("doc_id", "line").alias("match"), F.col("own").alias("__b"))
    both = first.join(others, "other")
    common = F.size(F.array_intersect("__a", "__b"))
    return both.filter(100 * common >= percent * (F.size("__a") + F.size("__b") - common)).select("d1", "d2", "match")


def later_matches(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, line, first_doc, first_line): lines that match an earlier one, and that one. Lines count from 0.

    Earlier is by doc_id, then line. A line matches if its words are the same, or if the Jaccard similarity of its tokens (five words
    in a row) is at least ``percent``, whether or not the earlier line is itself removed. A line of one to four words is a single token, its whole
    sequence, so it matches equal lines only; blank lines never match.

    Equal lines are one by two digests. Each line sends the prefix of its tokens, rarest first. Of the earliest lines that have its
    prefix tokens, a line is compared with the one that shares most of them, then, if that is not similar, with all earlier
    lines that pass the length and position filters. Full sets decide. Tokens that many lines have stand last in their order, so
    lines that share a common passage meet only where little else is left of either.
    Rows with a null doc_id are left alone; a repeated doc_id counts as one document with the rows' lines.
    """
    docs = docs.filter("doc_id is not null")
    rows = settle(_occurrences(docs))
    rank = _ranks(rows)
    occurrence = rows.filter("d1 is not null").drop("counts")
    classes = settle(occurrence.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "line")).alias("first")))
    met = settle(_met(_prefixes(docs, rank, percent)))
    # Different lines with one first digest keep together until their sets are compared.
    firsts = classes.groupBy("d1").agg(F.min("first").alias("first"), F.max("first").alias("last"))
    live = settle(met.join(firsts, "d1"))
    # Of lines that share a first digest, hardly ever any, all are asked for.
    alike = settle(live.filter("first <> last").select("d1").distinct())
    lines = settle(live.select("first.doc_id", "first.line").union(classes.join(alike, "d1", "left_semi").select("first.doc_id", "first.line")).distinct())
    sets = settle(_token_sets(docs, lines, rank))

    head = live.groupBy("token").agg(F.min(F.struct("first", "d1", "size", "at")).alias("h"))
    nearest = live.join(head, "token").filter(F.col("h.first") < F.col("last")).withColumns({"__size": F.col("h.size"), "__at": F.col("h.at")})
    counted = nearest.filter(_enough(percent)).groupBy("d1", F.col("h.d1").alias("other")).agg(F.count("*").alias("n"))
    pairs = settle(counted.groupBy("d1").agg(F.max_by("other", F.struct("n", "other")).alias("other")))
    found = settle(_verified(pairs, sets, percent))
    done = found.select(F.col("d1").alias("__done")).distinct()
    # Most lines are surely not done by their marks, and need not move to be told so.
    open_, maybe = (_named(live.select("d1", "token", "size", "at", F.col("first.doc_id").alias("__doc"), F.col("first.line").alias("__line"), F.col("last.doc_id").alias("__last_doc"),
                                       F.col("last.line").alias("__last_line")), found.select("d1").distinct(), "d1", there) for there in (False, True))
    last = F.struct(F.col("__last_doc").alias("doc_id"), F.col("__last_line").alias("line"))
    one = (F.col("__doc") == F.col("__last_doc")) & (F.col("__line") == F.col("__last_line"))
    left = open_.union(maybe.join(done, (F.col("d1") == F.col("__done")) & one, "left_anti")).select("d1", "token", "size", "at", last.alias("last"))
    other = live.select("token", F.col("d1").alias("other"), F.col("first").alias("__first"), F.col("size").alias("__size"), F.col("at").alias("__at"))
    low, high = F.least("size", "__size"), F.greatest("size", "__size")
    least = F.ceil(F.lit(percent) * (F.col("size") + F.col("__size")) / (100 + percent))  # tokens that similar lines share
    # Of the first token that two lines share, nothing before it is shared, so enough must be left from it on, in both.
    rest = F.least(F.col("size") - F.col("at"), F.col("__size") - F.col("__at"))
    shared = left.join(other, "token").filter((F.col("__first") < F.col("last")) & (100 * low >= percent * high) & (rest >= least)).groupBy("d1", "other").agg(
        F.count("*").alias("n"), F.max("at").alias("at"), F.max("__at").alias("__at"), F.max("size").alias("size"), F.max("__size").alias("__size"))
    # What they share before the last such token is counted; after it no more than the shorter rest is shared.
    close = shared.filter(F.col("n") + rest - 1 >= least).select("d1", "other")
    more = settle(_verified(settle(close.join(pairs, ["d1", "other"], "left_anti")), sets, percent))
    # The first line of a class is among the sets, so the least of them is what the class begins with.
    similar = found.union(more).groupBy("d1", "d2").agg(F.min("match").alias("match"))
    named = classes.join(similar, ["d1", "d2"], "left").select("d1", "d2", F.least("first", F.coalesce("match", "first")).alias("match"))
    return (occurrence.join(named, ["d1", "d2"]).filter(F.col("match") < F.struct("doc_id", "line"))
            .select("doc_id", "line", F.col("match.doc_id").alias("first_doc"), F.col("match.line").alias("first_line")))


def removed_lines(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_removed, lines, matches): of each document that loses lines, short ones too, their numbers in order and the earlier lines."""
    found = later_matches(docs, percent).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("line", "first_doc", "first_line"))).alias("all"))
    return found.select("doc_id", F.size("all").cast("long").alias("n_removed"), F.col("all.line").alias("lines"),
                        F.transform("all", lambda x: F.struct(x["first_doc"].alias("doc_id"), x["first_line"].alias("line"))).alias("matches"))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` without later matches, in the same columns; n_chars follows. A document whose words all go is left out.

    Other documents stay, those with a null or empty text as well. Repeated rows lose the same lines.
    """
    lost = removed_lines(docs, percent).select(F.col("doc_id").alias("__id"), F.col("lines").alias("__lost"))
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__lost", i)), "\n")
    step = docs.join(lost, F.col("doc_id") == F.col("__id"), "left").withColumn("__kept", F.when(F.col("__lost").isNotNull(), kept))
    step = step.filter(F.col("__kept").isNull() | (F.btrim("__kept", F.lit(" \t\n\x0b\x0c\r")) != ""))
    text = F.coalesce("__kept", "text")
    new = {"text": text, "n_chars": F.when(F.col("__kept").isNotNull(), F.char_length("__kept").cast("long")).otherwise(F.col("n_chars"))}
    return step.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
