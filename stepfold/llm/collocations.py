"""Phrases whose words stand together more often than chance, by an FM-index of word ids per shard."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepfold.llm.text import column, each_text, mix
from stepfold.plans.lineage import cut

SHARD = 1 << 21  # words and ends of pieces in a shard
SLICE = 1 << 20  # bytes of a text that are cut into words at once
BUCKETS, WITHIN = 1 << 12, 19  # of words by hash, and bits of a word's number in its bucket: ids have 31 bits
SUMMED = 1 << 20  # phrases of all shards whose counts are added up in one task, about
LONGEST = 5  # words of a phrase

_MARK = b"."  # one of the bytes that end pieces, so no word holds it
_FOLD = bytearray(range(256))
_FOLD[0x41:0x5B] = range(0x61, 0x7B)
for _byte in (*b".,;:!?", *range(0x0A, 0x0E)):
    _FOLD[_byte] = _MARK[0]
_FOLD[0x09] = 0x20
_FOLD = bytes(_FOLD)
_END = re.compile(rb"[. ]")


class _Bwt:
    """The Burrows-Wheeler transform of a sequence of ids whose suffixes are sorted by their first ``depth`` ids, with ranks of ids in it."""

    def __init__(self, seq: np.ndarray, depth: int):
        rank, have = seq.astype(np.int64), 1
        while have < depth:
            step = min(have, depth - have)  # where windows overlap, what they share is equal
            pair = rank * (int(rank.max(initial=0)) + 1) + np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64))
            have += step
            if have < depth:
                rank = np.unique(pair, return_inverse=True)[1]
        order = np.argsort(pair if depth > 1 else rank, kind="stable")
        self.ids = seq[order - 1]  # before the first one stands the last, both ends of pieces
        self.starts = np.append(0, np.cumsum(np.bincount(seq)))
        places = np.argsort(self.ids, kind="stable")
        self.keys = self.ids[places].astype(np.int64) * len(seq) + places

    def extend(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each interval by every id that stands before it: (interval, id, its low, its size, ids of the interval that are smaller)."""
        begin = np.append(0, np.cumsum(size))
        of = np.repeat(np.arange(len(low)), size)
        at = np.arange(begin[-1]) - begin[of] + low[of]
        most = len(self.starts)
        key = np.sort(of * most + self.ids[at])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        of, word, found = key[first] // most, key[first] % most, np.diff(np.append(first, len(key)))
        new = np.searchsorted(self.keys, word * len(self.ids) + low[of])  # starts of the id and its rank before low
        real = word > 0
        return of[real], word[real], new[real], found[real], (first - begin[of])[real]


class WordIndex:
    """A bidirectional FM-index of a sequence of ids from 1, where 0 ends a piece; it begins and ends with 0.

    A phrase has an interval among the sorted suffixes and one among the sorted reversed prefixes, both of as many places as it
    occurs. Extending it to the left narrows the first by the ids before its suffixes and moves the second past the smaller
    ones of them; to the right, the other way round. Sorting stops after ``depth`` ids, as phrases are no longer.
    """

    def __init__(self, seq: np.ndarray, depth: int):
        self.seq, self.depth = seq, depth

    @cached_property
    def forward(self) -> _Bwt:
        return _Bwt(self.seq, self.depth)

    @cached_property
    def backward(self) -> _Bwt:
        return _Bwt(self.seq[::-1], self.depth)

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts) of all phrases without 0 of 2 ids, then of 3, up to ``depth``; extended to the right and to the left by turns."""
        number = np.bincount(self.seq)
        words = np.flatnonzero(number)
        words = words[words > 0][:, None]
        size = number[words[:, 0]] if len(words) else np.zeros(0, np.int64)
        low = np.append(0, np.cumsum(number))[words[:, 0]] if len(words) else np.zeros(0, np.int64)
        here, there = low, low  # among suffixes and among reversed prefixes
        for n in range(2, self.depth + 1):
            if n % 2 == 0:
                of, word, there, size, smaller = self.backward.extend(there, size)
                here, words = here[of] + smaller, np.column_stack([words[of], word])
            else:
                of, word, here, size, smaller = self.forward.extend(here, size)
                there, words = there[of] + smaller, np.column_stack([word, words[of]])
            yield words, size


def _packed(ids: np.ndarray) -> bytes:
    return pa.compress(ids.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.int32)


def _pieces(ids: np.ndarray) -> np.ndarray:
    """The sequence with one 0 at each place where there are some, and at both ends."""
    ids = np.concatenate([[0], ids, [0]])
    return ids[np.append(True, (ids[1:] != 0) | (ids[:-1] != 0))]


def _sliced(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """Words and ends of pieces of a folded text, slice by slice, and whether the slice ends with a piece."""
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > SLICE and (end := _END.search(text, at + SLICE)):
            stop = end.end()
        whole = stop == len(text) or text[stop - 1:stop] == _MARK
        tokens = text[at:stop].replace(_MARK, b" . ").split()
        yield [*tokens, _MARK] if whole else tokens, whole
        at = stop


class _Numbers(dict):
    """Ids of the words of one language; the end of a piece is 0."""

    def __init__(self, numbers: Iterator[int]):
        super().__init__({_MARK: 0})
        self.numbers = numbers

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.numbers)
        return n


class _Shard:
    """Pieces of some texts as ids, which are apart for each language."""

    def __init__(self) -> None:
        self.numbers, self.words, self.parts, self.size = count(1), {}, [np.zeros(0, np.int32)], 0

    def take(self, lang: str, tokens: list[bytes]) -> None:
        if lang not in self.words:
            self.words[lang] = _Numbers(self.numbers)
        self.parts.append(np.fromiter(map(self.words[lang].__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(tokens)

    def rows(self, name: int) -> Iterator[pa.RecordBatch]:
        """The shard's sequence as one row, and a row for each of its words."""
        ids = _pieces(np.concatenate(self.parts))
        number = np.bincount(ids, minlength=next(self.numbers))
        yield _record(SHARDS, [[name], [len(ids)], [_packed(ids)], [None], [None], [None], [None]])
        for lang, words in self.words.items():
            local = np.fromiter(words.values(), np.int32, len(words))
            table = pa.table({"word": pa.array(list(words), pa.binary()).cast(pa.string()), "local": local, "n": number[local]})
            for part in table.filter(pa.array(local > 0)).to_batches(1 << 16):
                n = part.num_rows
                yield _record(SHARDS, [pa.array([name] * n), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array([lang] * n, pa.string()), *part.columns])


SHARDS = pa.schema([("shard", pa.int64()), ("size", pa.int32()), ("ids", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("local", pa.int32()), ("n", pa.int64())])


def _record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _shards(docs: DataFrame) -> DataFrame:
    """Shards of the texts as they are read: a row with the sequence (size, ids), and rows of the words (lang, word, local id, count)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = TaskContext.get().partitionId() << 24, _Shard()
        for batch in batches:
            for lang, text in zip(column(batch, "lang").to_pylist(), each_text(column(batch, "text")), strict=True):
                for tokens, whole in _sliced(text.translate(_FOLD)):
                    shard.take(lang, tokens)
                    if whole and shard.size >= SHARD:
                        yield from shard.rows(name)
                        name, shard = name + 1, _Shard()
        yield from shard.rows(name)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(run, "shard long, size int, ids binary, lang string, word string, local int, n long")


BLOCKS = pa.schema([("range", pa.int32()), ("shard", pa.int64()), ("words", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def _blocks(shard: int, found: Iterator[tuple[np.ndarray, np.ndarray]], ranges: int) -> pa.Table:
    """Phrases (a matrix of global ids) and their counts in a shard as packed blocks, one for each range of the phrases' hashes."""
    out: list[list] = [[], [], [], [], []]
    for ids, counts in found:
        hashed = np.zeros(len(ids), np.uint64)
        for column_ in ids.T:
            hashed = mix(hashed ^ column_.astype(np.uint64))
        where = (hashed % np.uint64(ranges)).astype(np.int32)
        order = np.lexsort((*ids.T[::-1], where))
        ids, counts, where = ids[order], counts[order], where[order]
        edges = np.append(np.flatnonzero(np.append(True, where[1:] != where[:-1])), len(where)) if len(where) else np.zeros(1, np.int64)
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            block = np.column_stack([ids[begin:end], counts[begin:end]])
            for values, value in zip(out, (int(where[begin]), shard, ids.shape[1], end - begin, _packed(block.T.ravel()))):
                values.append(value)
    return pa.table([pa.array(v, f.type) for v, f in zip(out, BLOCKS)], schema=BLOCKS)


def _summed(blocks: DataFrame, least: int) -> DataFrame:
    """Phrases with a sum of ``least`` (ids, f), and for each shard and range those that it has (shard, words, n, data)."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("f", pa.int64()), *[BLOCKS.field(c) for c in ("shard", "words", "n", "data")]])

    def add(table: pa.Table) -> pa.Table:
        shard, words, n, data = (table.column(c).to_pylist() for c in ("shard", "words", "n", "data"))
        parts = []
        for size in sorted(set(words)):
            mine = [k for k, w in enumerate(words) if w == size]
            rows = np.concatenate([_unpacked(data[k], n[k] * (size + 1)).reshape(size + 1, n[k]) for k in mine], axis=1)
            ids, counts = rows[:-1], rows[-1].astype(np.int64)
            order = np.lexsort(ids[::-1])
            new = np.append(True, (ids[:, order[1:]] != ids[:, order[:-1]]).any(axis=0))
            first = np.flatnonzero(new)
            sums = np.add.reduceat(counts[order], first)
            often = sums >= least
            kept = np.zeros(len(order), bool)
            kept[order] = often[np.cumsum(new) - 1]
            flat = ids[:, order[first[often]]].T.astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * size), pa.array(flat.ravel()))
            parts.append(pa.table([lists, pa.array(sums[often]), *[pa.nulls(len(flat), f.type) for f in list(schema)[2:]]], schema=schema))
            if size == 2:
                at = np.append(0, np.cumsum([n[k] for k in mine]))
                held = [(shard[k], ids[:, a:b][:, kept[a:b]]) for k, a, b in zip(mine, at[:-1], at[1:]) if kept[a:b].any()]
                parts.append(pa.table([pa.nulls(len(held), schema.field("ids").type), pa.nulls(len(held), pa.int64()), pa.array([k for k, _ in held], pa.int64()),
                                       pa.array([size] * len(held), pa.int32()), pa.array([x.shape[1] for _, x in held], pa.int32()),
                                       pa.array([_packed(x.ravel()) for _, x in held], pa.binary())], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return blocks.groupBy("range").applyInArrow(add, "ids array<long>, f long, shard long, words int, n int, data binary")


def _renumbered(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's sequence in ids from 1 of its frequent words, with 0 for all others, the words' global ids by those, and its pairs (a key each)."""
    size, data = left.column("size")[0].as_py(), left.column("ids")[0].as_py()
    is_word = right.column("data").is_null()
    x, y = (right.filter(is_word).column(c).to_numpy() for c in ("x", "y"))
    names = np.append(0, np.sort(y))
    ids = _unpacked(data, size)
    new = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
    new[x] = np.searchsorted(names, y)
    pairs = [np.zeros((2, 0), np.int64)]
    for r in right.filter(pc.invert(is_word)).select(["n", "data"]).to_pylist():
        pairs.append(np.searchsorted(names, _unpacked(r["data"], 2 * r["n"]).reshape(2, r["n"])))
    first, second = np.concatenate(pairs, axis=1)
    return _pieces(new[ids]), names, first * len(names) + second


def _of_frequent_pairs(seq: np.ndarray, pairs: np.ndarray, most: int) -> np.ndarray:
    """Runs of three words and more in which each two neighbours are a frequent pair (first * most + second)."""
    linked = np.isin(seq[:-1].astype(np.int64) * most + seq[1:], pairs)
    linked = np.concatenate([[False], linked, [False]])  # of a word with the one before it and the one after it
    before, after = linked[:-1], linked[1:]
    keep = before & after
    keep[:-1] |= keep[1:] & after[:-1]  # the first of a run
    keep[1:] |= before[1:] & (before & after)[:-1]  # and its last
    begins = keep & ~(before & np.append(False, keep[:-1]))
    at = np.flatnonzero(keep)
    out = np.zeros(len(at) + int(begins.sum()) + 1, np.int32)
    out[np.arange(len(at)) + np.cumsum(begins[at])] = seq[at]
    return out


def counted(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (id, lang, word, f), phrases of 1 to LONGEST words (ids, f) that occur ``least`` times in a language, and (lang, n) of all words.

    A phrase is frequent only if its words are, and all pairs of neighbours in it. So shards are searched twice: for pairs of frequent
    words, then, where frequent pairs follow one another, for longer phrases. Each time a shard's FM-index enumerates its phrases
    with counts, and sums over the shards decide. Phrases move as packed blocks by ranges of their hashes. What a shard has to know of the
    others' sums comes to it as rows of its own words and blocks of its own pairs.
    """
    found = cut(_shards(docs))
    words = found.filter("word IS NOT NULL")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    # One shuffle and one sort give a word's sum and its id: the words of a bucket stand together, in order.
    dealt = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS))).repartition("bucket")
    summed = dealt.withColumn("f", F.sum("n").over(Window.partitionBy("bucket", "lang", "word"))).filter(F.col("f") >= least)
    nth = F.dense_rank().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    within = F.when(nth < 1 << WITHIN, nth).otherwise(F.raise_error(F.lit("too many frequent words for their ids")))
    kept = cut(summed.select("lang", "word", "f", "shard", F.col("local").cast("long").alias("x"), (F.shiftleft("bucket", WITHIN) + within).alias("y")))
    vocabulary = kept.select(F.col("y").alias("id"), "lang", "word", "f").distinct()
    own = kept.select("shard", "x", "y", F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("data"))
    sequences = found.filter("ids IS NOT NULL").select(F.col("shard").alias("name"), "size", "ids")
    ranges = int(sequences.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0) // SUMMED + 1

    def search(known: DataFrame, depth: int) -> DataFrame:
        """Phrases of two words, or of frequent pairs up to ``depth`` words."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return BLOCKS.empty_table()
            seq, names, pairs = _renumbered(left, right)
            index = WordIndex(seq if depth == 2 else _of_frequent_pairs(seq, pairs, len(names)), depth)
            return _blocks(left.column("name")[0].as_py(), ((names[ids], n) for ids, n in index.phrases() if depth == 2 or ids.shape[1] > 2), ranges)

        both = sequences.groupBy("name").cogroup(known.groupBy("shard"))
        return _summed(both.applyInArrow(run, "range int, shard long, words int, n int, data binary"), least)

    pairs = cut(search(own, 2))
    held = pairs.filter("data IS NOT NULL").select("shard", F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("y"), "n", "data")
    longer = search(own.union(held), LONGEST)
    phrases = vocabulary.select(F.array("id").alias("ids"), "f").union(pairs.filter("ids IS NOT NULL").select("ids", "f")).union(longer.filter("ids IS NOT NULL").select("ids", "f"))
    return vocabulary, cut(phrases), totals


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 5 words by score, then count, then text.

    Words stand between blanks in pieces of the texts, A-Z in lower case; a phrase never crosses the end of a piece, and n counts all words
    of its language. A phrase that occurs a >= ``least`` times scores floor(1000 * a * n / (l * r)) at the cut where that is smallest, the first
    of equal ones; l and r are the counts of what stands before and after the cut. Numbers are exact, in decimals. Phrases go that a
    longer frequent one holds as often as they occur; one word more is enough to look at, as counts only fall with length.

    A null language is ``und``, a null or empty text has no words; repeated rows count each time, other columns are ignored. An
    empty table gives no rows. A shard holds some SHARD words, and one piece of a text is never divided, so a task needs memory for as much.
    """
    vocabulary, phrases, totals = counted(docs, least)
    size = F.size("ids")
    part = [F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1)]
    held = phrases.filter(size > 2).select(F.explode(F.array(*part)).alias("ids"), "f").distinct()
    left = phrases.filter(size > 1).join(held, ["ids", "f"], "left_anti")
    at = left.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    at = at.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = (at.join(phrases.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(phrases.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
            .withColumn("id", F.col("ids")[0]).join(vocabulary.select("id", "lang"), "id").join(totals, "lang"))
    score = F.expr("(CAST(1000 * CAST(a AS DECIMAL(20,0)) AS DECIMAL(24,0)) * CAST(n AS DECIMAL(14,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))")
    best = cuts.groupBy("lang", "n", "ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "n", "ids", "a", "c.score", "c.l", "c.r")
    order = [F.col("score").desc(), F.col("a").desc()]
    near = best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top).drop("place")
    texts = (near.select("ids", F.posexplode("ids").alias("pos", "id")).join(vocabulary.select("id", "word"), "id")
             .groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w")).select("ids", F.array_join("w.word", " ").alias("phrase")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    return (near.join(texts, "ids").withColumn("rank", rank).filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


OP12_SQL = r"""
WITH lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
counts AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places
    GROUP BY ALL HAVING count(*) >= 100),
longer AS (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:k], ' ')]) AS phrase
    FROM counts WHERE k > 2),
candidate AS (
    SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS place FROM counts c
    WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM longer l WHERE l.lang = c.lang AND l.phrase = c.phrase AND 100 * l.f >= 100 * c.f)),
cuts AS (
    SELECT c.lang, c.phrase, c.a, place, l.f AS l, r.f AS r, n, ((1000 * a::HUGEINT * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM candidate c JOIN totals t ON t.lang = c.lang
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:c.place], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[c.place + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
WHERE rank <= 2000
"""
