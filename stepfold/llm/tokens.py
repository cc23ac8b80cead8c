"""Token ids of whole texts with the files of public tokenizers."""

from __future__ import annotations

import gc
import re
import sys
from array import array
from functools import lru_cache

import pyarrow as pa

#: Words kept by a worker before the older half goes; bounds its memory, not the result.
KEPT_WORDS = 250_000
#: Characters that are their own composed form and whose lower case is one character.
_SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Pieces that the tokenizer cuts a word of those into, after lower-casing: fixed by its file.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies use for each byte: printable ones stand for themselves, the others follow from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(rest)}


_LETTERS = _byte_letters()


class Kept(dict):
    """A cache of two generations: when the newer is full the older one goes, so that what is used stays."""

    def __init__(self, make, most: int = KEPT_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file that drops white space and never joins what it separates.

    Then the ids of a text are those of its words, one after the other, and a word seen before costs a
    look-up. Words of simple letters are cut into the file's pieces, which are kept too; all others go through the whole
    tokenizer. Ids are little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = Kept(self._word)
        self.pieces = Kept(self._piece)

    def _word(self, word: bytes) -> bytes:
        text = word.decode(errors="replace")
        if "<|" in text or not _SIMPLE.fullmatch(text):
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_LETTERS)
        return _bytes([t.id for t in self.model.tokenize(piece)])

    def __call__(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def forget() -> None:
    """Drop the words that this worker keeps for texts of an earlier step, so that they don't lie beside another step's arrays."""
    if word_encoder.cache_info().currsize:
        word_encoder.cache_clear()
        gc.collect()  # an encoder and its words refer to each other
        pa.default_memory_pool().release_unused()


@lru_cache(maxsize=2)
def piece_model(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def json_model(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text as the library of the file gives them, without added ones."""
    if path.endswith(".json"):
        return [len(e.ids) for e in json_model(path).encode_batch(texts, add_special_tokens=False)]
    return [len(ids) for ids in piece_model(path).encode(texts, num_threads=1)]
