"""SentencePiece ids through a table of every prefix's last token, and texts back from ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stepfold.llm.text import column
from stepfold.llm.tokens import Kept

SPACE = "▁"
SLICE = 1 << 20  # characters or ids handled at once, so that very long texts need little memory
KEPT = 64  # characters of a word that is kept; longer ones are worked out each time
BATCH_CHARS = 1 << 22  # characters of texts whose ids go back to Spark together


class _Words(Kept):
    """A cache of short strings; longer ones are worked out each time."""

    def __missing__(self, key):
        return super().__missing__(key) if len(key) <= KEPT else self.make(key)


class PieceCodec:
    """Ids of texts and texts of ids by a BPE model file of SentencePiece, without its encoder.

    The merges of a text give each of its prefixes one last token, and a row of tokens is what the merges give exactly if each
    neighbouring pair is: were a merge across some boundary the first to happen, it would also happen in the pair alone. So one pass over a
    string fills a table: of the pieces that end at a place, as an automaton finds them, the last token is the one that the merges leave whole
    beside the last token of the prefix before it. Ids are read from the table's end backwards.

    Characters that no piece holds are never merged; they become byte ids, or the unknown id in files without those. Where no piece has
    a space mark behind another character, texts are cut before the spaces, and words are kept by a worker.
    Files that normalise texts, that have pieces of the user or unused ones, or that have pieces with characters that are none are refused.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kind = proto.ModelProto.SentencePiece
        spec, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != proto.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces \
                or train.treat_whitespace_as_suffix or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: only BPE files without normalisation, user-defined and unused pieces are read")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.end_id, self.unknown = train.eos_id, train.unk_id
        self.pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.names = [p.piece for p in model.pieces]
        self.rank = {p: r for r, p in enumerate(sorted(self.pieces, key=lambda p: -model.pieces[self.pieces[p]].score))}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE} if train.byte_fallback else {}
        self.never = len(self.rank)
        self.histories = Kept(self._history, len(self.pieces))
        self.known = {p for p in self.pieces if len(p) == 1}
        if not self.known.issuperset("".join(self.pieces)):
            raise ValueError(f"{path}: a piece has a character that is no piece")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.pieces.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.fits = Kept(self._fits)
        self.words = _Words(self._ids)
        apart = "".join(c for c in "\t\n\r" if c not in self.known)  # one of these is merged with nothing
        cut = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|[{apart}]+" if apart else "")) if cut else None
        self.before_space = re.compile(f"(?<!{SPACE}){SPACE}")
        plain = {kind.NORMAL: lambda p: p.piece.replace(SPACE, " ").encode(), kind.BYTE: lambda p: bytes([int(p.piece[3:5], 16)]),
                 kind.UNKNOWN: lambda p: train.unk_surface.encode()}
        self.surface = [plain.get(p.type, lambda p: b"")(p) for p in model.pieces]
        self.controls = {i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL}

    def _history(self, piece: str) -> tuple[list[int], list[str], list[str]] | None:
        """The ranks of the merges of a piece by itself, in order, and its first and last part before each and after all; None if it isn't left whole.

        A merge joins the neighbours that form the best-ranked piece, the leftmost of equal ones.
        """
        parts, rank = list(piece), self.rank
        ranks, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            found = [rank.get(a + b, self.never) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best == self.never:
                return None
            k = found.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            ranks.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return [*ranks, self.never], firsts, lasts

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the merges leave the second token whole behind the first one (-1: at the start).

        The merges of both run side by side, the better rank first and the left one of equal ranks, until the parts beside the boundary are merged
        or nothing is left to do.
        """
        token = self.histories[self.names[pair[1]]]
        if token is None or pair[0] < 0:
            return token is not None
        left, _, lasts = self.histories[self.names[pair[0]]]
        right, firsts, _ = token
        i = j = 0
        while True:
            across = self.rank.get(lasts[i] + firsts[j], self.never)
            if across < left[i] and across <= right[j] and across < self.never:
                return False
            if left[i] <= right[j]:
                if left[i] == self.never:
                    return True
                i += 1
            else:
                j += 1

    def _table(self, text: str) -> list[int]:
        """Ids of a string of known characters."""
        last, fits = [-1] * (len(text) + 1), self.fits
        for at, (token, size) in self.automaton.iter(text):
            if last[at + 1] < 0 and fits[last[at + 1 - size], token]:
                last[at + 1] = token
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= len(self.names[last[at]])
        return ids[::-1]

    def _string(self, text: str) -> list[int]:
        if self.known.issuperset(text):
            return self._table(text)
        ids: list[int] = []
        for known, run in groupby(text, self.known.__contains__):
            if known:
                ids += self._table("".join(run))
            elif self.bytes:
                ids += [self.bytes[b] for b in "".join(run).encode()]
            else:
                ids += [self.unknown]  # neighbours without a piece are one
        return ids

    def _ids(self, text: str) -> bytes:
        return np.asarray(self._string(text), np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, as int32, without begin or end."""
        if not text:
            return np.zeros(0, np.int32)
        text = self.prefix + text.replace(" ", SPACE)
        if self.cut is None:
            return np.asarray(self._string(text), np.int32)
        out, at = [], 0
        while at < len(text):
            stop = len(text)
            if stop - at > SLICE and (space := self.before_space.search(text, at + SLICE)):
                stop = space.start()
            out += map(self.words.__getitem__, self.cut.findall(text[at:stop]))
            if len(out) > SLICE:
                out = [b"".join(out)]
            at = stop
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Control ids are empty; bytes that form no character become U+FFFD, one each."""
        runs = [b"".join(map(self.surface.__getitem__, ids[k:k + SLICE].tolist())) for k in range(0, len(ids), SLICE)]
        data = b"".join(runs)
        first = next((t for t in map(int, ids) if t not in self.controls), None)
        skip = int(bool(self.prefix) and first is not None and self.names[first].startswith(SPACE))
        try:
            return data[skip:].decode()
        except UnicodeDecodeError:
            of_byte = set(self.bytes.values())
            parts = []
            for is_byte, run in groupby(map(int, ids), of_byte.__contains__):
                data = b"".join(map(self.surface.__getitem__, run))
                parts.append(_characters(data) if is_byte else data.decode())
            return "".join(parts)[skip:]


def _characters(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at:at + n].decode())
            except UnicodeDecodeError:
                continue
            at += n
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def piece_codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encoded(docs: DataFrame, model: str, end: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of their whole texts, then the end id if ``end``, and ``decoded``, the text of those ids.

    A null or empty text has the end id alone and decodes to an empty text. Every row is worked on by itself where it is read, so
    nothing moves; repeated rows and rows without ``doc_id`` stay, columns of those two names are replaced.
    """
    own = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = T.StructType([*docs.select(*own).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model)
        tail = np.asarray([codec.end_id], np.int32)

        def record(part: pa.RecordBatch, ids: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
            at = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(texts, pa.string())],
                                              names=[*own, "ids", "decoded"])

        for batch in batches:
            ids, texts, chars, first = [], [], 0, 0
            for k, value in enumerate(column(batch, "text")):
                text = value.as_py() or ""
                row = codec.encode(text)
                ids.append(np.concatenate([row, tail]) if end else row)
                texts.append(codec.decode(ids[-1]))
                chars += len(text)
                if chars >= BATCH_CHARS:
                    yield record(batch.slice(first, k + 1 - first), ids, texts)
                    ids, texts, chars, first = [], [], 0, k + 1
            if first < batch.num_rows:
                yield record(batch.slice(first), ids, texts)

    return docs.select(*own).mapInArrow(run, schema)
