"""op6 and op7 over the whole smallest table against plain versions."""

import hashlib
import re
from collections import Counter

import pytest

from stepfold.llm.queries import REGISTRY, table
from tests.llm import brute
from tests.llm.test_queries import SF_DIR


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text or "") for r in table(spark, SF_DIR, "documents").collect())


def paragraphs(text: str) -> Counter:
    """Stretches of bytes: to a line's or sentence's end, or a word that its own bytes choose."""
    data, out, begin, words = text.encode(), Counter(), None, list(re.finditer(rb"[^\x20\x09-\x0D]+", text.encode()))
    for k, word in enumerate(words):
        begin = word.start() if begin is None else begin
        w = word.group()
        closes = w[-1:] in (b".", b"!", b"?") or (w[0] * 7 + w[-1] * 31 + len(w) * 13) % 12 == 0
        if closes or k + 1 == len(words) or b"\n" in data[word.end():words[k + 1].start()]:
            out[data[begin:word.end()]] += 1
            begin = None
    return out


def jaccard(a: Counter, b: Counter) -> float:
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_fingerprints_of_the_table(spark, texts):
    got = {r.doc_id: r for r in REGISTRY["op6_paragraph_fingerprints"](spark, SF_DIR).collect()}
    assert len(got) == len(texts)
    prints = {}
    for k, (doc_id, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + following[:quarter]
        row, own = got[doc_id], paragraphs(text)
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert row.near_edited == pytest.approx(jaccard(own, paragraphs(edited)), abs=1e-12)
        assert row.near_next == pytest.approx(jaccard(own, paragraphs(following)), abs=1e-12)
        for value, words in ((row.fingerprint, own), (row.edited_fingerprint, paragraphs(edited))):
            assert prints.setdefault(frozenset(words.items()), value) == value
    assert len(set(prints.values())) == len(prints)


def test_license_phrases_of_the_table(spark, texts):
    got = {r.doc_id: r for r in REGISTRY["op7_license_scan"](spark, SF_DIR).collect()}
    for doc_id, text in texts:
        row = got[doc_id]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == brute.license_base(text)
        assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(",")) and 0 <= row.score <= 1
