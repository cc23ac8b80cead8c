"""Near-duplicate documents by a chosen-path set similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.components import components
from stepfold.llm.tables import settle
from stepfold.llm.text import column, hash_spans, in_batches, lowered, mix, raw, words
from stepfold.llm.tokens import forget

WIDTH = 5  # words of a shingle
SKETCH = 64  # minwise tokens of a set that trees branch by
FINE = 512  # minwise tokens of a set, of which a byte each is compared in the second pass; the first SKETCH of them in the first
TREES = 12  # a pair of similarity 0.75 shares no root branch with probability 0.25 ** 12, 6e-8
NODE = 4096  # members of a node that are compared exhaustively
BRANCHES = 2  # paths by which a larger node is split: a pair of similarity 0.75 stays together with probability 0.94 per level and tree
DEPTH = 4
FEW = 16  # candidates that a member of a node sends as pairs in the second pass; with more, its full set comes to the node
#: Agreeing bytes of a candidate in either pass: at similarity 0.75, fewer have a probability of about 1e-6.
LEAST, LEAST_FINE = 32, 337

_RANDOM = np.random.Generator(np.random.PCG64(11))
_TURNS = _RANDOM.integers(1, 2**63, FINE, dtype=np.uint64) | np.uint64(1)
_MASKS = _RANDOM.integers(0, 2**63, FINE, dtype=np.uint64)
_STEPS = _RANDOM.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lowered, words between blanks, five in a row, or all if fewer."""
    data, at = raw(texts)
    data = lowered(data)
    begins, ends, first = words(data, at)
    hashes = hash_spans(data, begins, ends)
    rows = np.zeros(len(hashes), np.uint64)
    n = len(hashes) - WIDTH + 1
    if n > 0:
        total = hashes[:n] * _STEPS[0]
        for k in range(1, WIDTH):
            total += hashes[k:k + n] * _STEPS[k]
        rows[:n] = mix(total)
    for b, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - b >= WIDTH:
            yield np.unique(rows[b:e - WIDTH + 1])
        elif e > b:
            yield mix((hashes[b:e] * _STEPS[:e - b]).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - b))
        else:
            yield np.zeros(0, np.uint64)


def _minwise(own: np.ndarray) -> np.ndarray:
    """The smallest of the set's hashes under each of FINE orders, upper 32 bits."""
    low = np.full(FINE, np.iinfo(np.uint64).max)
    for i in range(0, len(own), 256):
        low = np.minimum(low, ((own[None, i:i + 256] ^ _MASKS[:, None]) * _TURNS[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4")


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch, fine): digest names the set; the last three are null for an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()),
                        ("fine", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sizes, digests, marks, fine = [], [], [], []
            for own in shingle_sets(column(batch, "text")):
                sizes.append(len(own))
                if len(own):
                    sums = [len(own), int(own.sum(dtype=np.uint64)), int(mix(own ^ _MASKS[0]).sum(dtype=np.uint64))]
                    digests.append(np.array(sums, "<u8").tobytes())
                    low = _minwise(own)
                    marks.append(low[:SKETCH].tobytes())
                    fine.append(low.astype(np.uint8).tobytes())
                else:
                    for rows in (digests, marks, fine):
                        rows.append(None)
            yield _batch(schema, [column(batch, "doc_id"), sizes, digests, marks, fine])

    return in_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary, fine binary")


def _position(k: int):
    return F.expr(f"substring(sketch, {4 * k + 1}, 4)")


def _rows(docs: DataFrame) -> DataFrame:
    """A row per tree and set: the root branch is the set's minwise token of that tree."""
    keys = F.array(*[F.xxhash64(F.lit(k), _position(k)) for k in range(TREES)])
    return docs.select(F.explode(keys).alias("key"), "rep", "label", "sketch", "marks")


def _nodes(docs: DataFrame, node: int, joined: bool) -> DataFrame:
    """Rows (key, rep, label, sketch, marks) of small nodes: those above ``node`` members branch again, by BRANCHES further tokens each.

    What is still too large after DEPTH rounds is a dense group. It is dealt into blocks of about ``node`` / 2, with a pivot in every
    one. Once components are ``joined``, each member outside the pivot's stands in every block too, so that members of
    different components always meet.
    """
    rows, small = _rows(docs), []
    for depth in range(DEPTH):
        large = settle(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > node))
        if large.isEmpty():
            return _all([*small, rows])
        small.append(rows.join(large, "key", "left_anti"))
        inner = rows.join(large.select("key"), "key")
        # Which tokens a path goes on with is drawn from the path: any of those that no root uses.
        paths = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)),
                                      lambda b: TREES + F.pmod(F.xxhash64(F.lit(depth), F.col("key"), b), F.lit(SKETCH - TREES)))).alias("at")
        step = inner.select("key", "rep", "label", "sketch", "marks", paths)
        rows = settle(step.select(F.xxhash64("key", "at", F.expr("substring(sketch, int(4 * at + 1), 4)")).alias("key"), "rep", "label", "sketch", "marks").distinct())
    large = settle(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).filter(F.col("n") > node)
                .withColumn("blocks", F.ceil(F.col("n") * 2 / node)))
    small.append(rows.join(large, "key", "left_anti"))
    pivots = rows.join(large, "key").filter("rep = pivot").select("key", F.col("label").alias("main"))
    inner = rows.join(large, "key").join(pivots, "key")
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    strays = (F.col("rep") == F.col("pivot")) | (F.lit(joined) & (F.col("label") != F.col("main")))
    own = F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = inner.select("key", "rep", "label", "sketch", "marks", F.explode(F.when(strays, everywhere).otherwise(own)).alias("block"))
    small.append(dealt.select(F.xxhash64("key", "block").alias("key"), "rep", "label", "sketch", "marks"))
    return _all(small)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _unlike(label: np.ndarray, marks: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each member outside a node's largest component, with the candidates of other labels and their agreement; every pair once."""
    names, place, size = np.unique(label, return_inverse=True, return_counts=True)
    main = place == size.argmax()  # pairs of its members need no comparison
    for i in np.flatnonzero(~main).tolist():
        other = np.flatnonzero((main | (np.arange(len(label)) < i)) & (label != label[i]))
        same = np.concatenate([np.count_nonzero(marks[other[j:j + 4096]] == marks[i], axis=1) for j in range(0, max(1, len(other)), 4096)])
        yield i, other[same >= least], same[same >= least]


def _compare(forest: bool, width: int, least: int):
    """Candidates of each node. ``forest``: each member's nearest earlier and nearest later one; else all that differ in label.

    Of the latter, a member with more than FEW names no pairs. It and its candidates are rows (key, a) without b, each once a node, so
    the rows of a node grow with its members and not with their pairs.
    """
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32())])

    def node(rep: np.ndarray, label: np.ndarray, marks: np.ndarray, many: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, found = len(rep), []
        if not forest:
            for i, part, same in _unlike(label, marks, least):
                if len(part) > FEW:
                    many[i] = True
                    many[part] = True
                else:
                    found.append((np.minimum(rep[part], rep[i]), np.maximum(rep[part], rep[i]), same))
            return found
        later_best, later_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(0, n, 128):
            j = min(n, i + 128)
            same = np.count_nonzero(marks[i:j, None, :] == marks[None, :j, :], axis=2)
            same[np.arange(j)[None, :] >= np.arange(i, j)[:, None]] = 0
            best = same.argmax(axis=1)
            value = same[np.arange(j - i), best]
            ok = value >= least
            found.append((best[ok], np.arange(i, j)[ok], value[ok]))
            top = same.max(axis=0)
            better = top > later_best[:j]
            later_at[:j][better] = same.argmax(axis=0)[better] + i
            later_best[:j][better] = top[better]
        ok = later_best >= least
        found.append((np.flatnonzero(ok), later_at[ok], later_best[ok]))
        return [(rep[a], rep[b], v) for a, b, v in found]

    def nodes(key: np.ndarray, rep: np.ndarray, label: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(at, len(key)))
        a = at[sizes == 2]
        same = np.count_nonzero(marks[a] == marks[a + 1], axis=1) if len(a) else np.zeros(0, np.int64)
        ok = (same >= least) & (label[a] != label[a + 1]) & (rep[a] != rep[a + 1]) if len(a) else np.zeros(0, bool)
        found = [(rep[a[ok]], rep[a[ok] + 1], same[ok])] if len(a) else []
        many = np.zeros(len(key), bool)
        for b, n in zip(at[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            found += node(rep[b:b + n], label[b:b + n], marks[b:b + n], many[b:b + n])
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        differ = columns[0] != columns[1]
        pairs = [pa.nulls(int(differ.sum()), pa.int64()), *[pa.array(c[differ], f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]]
        rest = [pa.array(key[many]), pa.array(rep[many]), pa.nulls(int(many.sum()), pa.int64()), pa.nulls(int(many.sum()), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(pairs, rest, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last node may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.frombuffer(b"".join(column(batch, "marks").to_pylist()), np.uint8).reshape(-1, width)
            now = [column(batch, c).to_numpy(zero_copy_only=False) for c in ("key", "rep", "label")] + [marks]
            if held is not None:
                now = [np.concatenate(pair) for pair in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1]))
            held = [c[last:] for c in now]
            if last:
                yield nodes(*[c[:last] for c in now])
        if held is not None:
            yield nodes(*held)

    return run


def _candidates(rows: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b, agree), a < b; in the second pass also (key, a) of the members that have many, and of those they have."""
    sent = rows.select("key", "rep", "label", "marks").repartition("key").sortWithinPartitions("key", "rep")
    width, least = (SKETCH, LEAST) if forest else (FINE, LEAST_FINE)
    return sent.mapInArrow(_compare(forest, width, least), "key long, a long, b long, agree int")


def _sets(docs: DataFrame, active: DataFrame) -> DataFrame:
    """(rep, own): the full shingle sets of the documents that have a candidate."""
    schema = pa.schema([("rep", pa.int64()), ("own", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch(schema, [column(batch, "doc_id"), [s.view(np.int64) for s in shingle_sets(column(batch, "text"))]])

    # Texts always move here, whatever the size of ``active``, so the plan is the same at every size.
    chosen = docs.select("doc_id", "text").join(active.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    return in_batches(chosen).mapInArrow(run, "rep long, own array<bigint>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    first = pairs.join(sets.select(F.col("rep").alias("a"), F.col("own").alias("__a")), "a")
    both = first.join(sets.select(F.col("rep").alias("b"), F.col("own").alias("__b")), "b")
    shared = F.size(F.array_intersect("__a", "__b"))
    union = F.size("__a") + F.size("__b") - shared
    return both.filter(100 * shared >= percent * union).select("a", "b")


def _confirm_nodes(many: DataFrame, labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed pairs (a, b) of the nodes (key, a): all candidates of other labels are compared on the full sets that come to the node.

    One pair joins two components, so later pairs of theirs need no comparison and a node gives a forest. Nodes are small (see ``_nodes``).
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def node(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, label = table.column("rep").to_numpy(), table.column("label").to_numpy()
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(-1, FINE)
        own = table.column("own").chunk(0)
        values, at = own.values.to_numpy().view(np.uint64), own.offsets.to_numpy()
        sizes, joined, found = np.diff(at), label.copy(), []
        for i, part, _ in _unlike(label, marks, LEAST_FINE):
            mine = values[at[i]:at[i + 1]]
            for j in range(0, len(part), 256):
                other = part[j:j + 256]
                other = other[joined[other] != joined[i]]
                if not len(other):
                    continue
                theirs = np.concatenate([values[at[k]:at[k + 1]] for k in other.tolist()])
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                shared = np.add.reduceat(hit.astype(np.int64), np.append(0, np.cumsum(sizes[other])[:-1]))
                for k in other[100 * shared >= percent * (len(mine) + sizes[other] - shared)].tolist():
                    if joined[k] != joined[i]:
                        found.append(sorted((int(rep[i]), int(rep[k]))))
                        joined[joined == joined[k]] = joined[i]
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], schema=schema)

    members = many.select("key", F.col("a").alias("rep")).distinct()
    there = members.join(labelled.select("rep", "label", "marks"), "rep").join(sets, "rep")
    return there.groupBy("key").applyInArrow(node, "a long, b long")


def groups(docs: DataFrame, percent: int = 75, node: int = NODE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``.

    Equal sets are one member, named by its smallest doc_id. Sets are sketched by minwise tokens, TREES trees branch by them (see
    ``_nodes``), and small nodes are compared exhaustively. A first pass takes the nearest earlier candidate of each member, confirms
    it on the full sets and joins components; a second compares what is still in different components, all of it, and
    confirms again: pairs one by one, and members with many candidates in their nodes. So a dense group costs a forest, not a row for
    each of its pairs, and no link between components is left out.

    Null and empty texts, and those without words, are linked with nothing. Repeated rows get the same answer, each. A row with a null
    doc_id has a component only through others with the same set. ``kept``: doc_id = component_id, or there is no component.
    """
    marked = settle(sketches(docs))
    named = settle(marked.filter("digest is not null and doc_id is not null").groupBy("digest")
                .agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("fine").alias("fine")))
    members = named.select("rep", F.col("rep").alias("label"), "sketch", F.expr(f"substring(fine, 1, {SKETCH})").alias("marks"))

    found = settle(_candidates(_nodes(members, node, False), True).groupBy("a", "b").agg(F.max("agree").alias("agree")))
    ends = found.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    active = settle(named.join(ends, "rep"))
    # A rep's rows may be repeated; they have one text's set, and one is enough.
    sets = settle(_sets(docs, active).groupBy("rep").agg(F.first("own").alias("own")))
    nearest = found.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b")
    edges = settle(_confirm(nearest, sets, percent))
    first = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("label"))

    labelled = settle(active.join(first, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"), "sketch", F.col("fine").alias("marks")))
    second = settle(_candidates(_nodes(labelled, node, True), False).select("key", "a", "b").distinct())
    open_, many = second.filter("b IS NOT NULL").select("a", "b"), second.filter("b IS NULL").select("key", "a")
    more = settle(_confirm(open_.join(nearest, ["a", "b"], "left_anti"), sets, percent))
    if not many.isEmpty():
        more = settle(more.union(_confirm_nodes(many, labelled, sets, percent)))
    if not more.isEmpty():
        edges = edges.union(more)
        first = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    ids = named.join(first, "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return (marked.select("doc_id", "n_shingles", "digest").join(ids, "digest", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept")))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, with the smallest doc_id; repeated rows of it go, those without an id stay."""
    kept = groups(docs, percent).filter("kept").select("doc_id").distinct()
    one = docs.join(kept.filter("doc_id is not null"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.select(docs.columns).union(docs.filter("doc_id is null"))
