"""License texts whose lines are broken anywhere, against a plain version of blocks."""

import random
import textwrap

import numpy as np
import pyarrow as pa

from stepfold.llm import license_scan
from tests.llm import brute


def words_of(text):
    return brute._LICENSE_WORD.findall(brute.lower(text))


def found(text, percent=90):
    """label: the largest share of a line or paragraph that isn't far longer than the template, and of any stretch of words as long as it."""
    lines = [words_of(x) for x in text.split("\n")]
    blocks, paragraph = list(lines), []
    for x in [*lines, []]:
        if not x:
            blocks.append(paragraph)
            paragraph = []
        paragraph = paragraph + x
    whole, out = words_of(text), {}
    for label, template in license_scan.TEMPLATES:
        own, n = set(words_of(template)), len(words_of(template))
        for block in [*(x for x in blocks if len(x) <= license_scan.LOOSE * n), *(whole[i:i + n] for i in range(len(whole)))]:
            shared = len(own & set(block))
            if 100 * shared >= percent * len(own):
                out[label] = max(out.get(label, 0.0), shared / len(own))
    return out


def scanned(spark, texts):
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r for r in rows}


def test_hard_wrapped_templates(spark):
    """Comment marks and line ends do not hide a template, nor do blank lines in the middle."""
    texts, labels = [], []
    for label, template in license_scan.TEMPLATES:
        for width in (20, 34, 76):
            for begin, gap in (("", "\n"), (" * ", "\n"), ("# ", "\n\n"), ("rem ", "\n")):
                texts.append("Some program\n\n" + gap.join(begin + x for x in textwrap.wrap(template, width)) + "\n\nint x;")
                labels.append((label, begin))
    got = scanned(spark, texts)
    for i, (label, begin) in enumerate(labels):
        assert label in got[i].labels.split(","), texts[i]
        assert max(b.share for b in got[i].blocks if b.label == label) == 1.0 and got[i].score == 1.0
        if begin != "rem ":
            assert [b.line for b in got[i].blocks if b.label == label and b.share == 1.0] == [2], texts[i]


def test_blocks_against_the_plain_version(spark):
    r = random.Random(11)
    texts = ["", "\n\n", "All\nrights", "reserved"]
    for _ in range(300):
        parts = []
        for _ in range(r.randint(1, 4)):
            words = r.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(r.choice((0, 0, 1, 2, 3))):
                words[r.randrange(len(words))] = r.choice(("stone", "the", "", "of mine"))
            parts += words + ["word"] * r.choice((0, 1, 30))
        texts.append("".join(w + r.choice((" ", " ", "\n", "\n \n" if r.random() < 0.2 else " ")) for w in parts))
    got = scanned(spark, texts)
    for i, text in enumerate(texts):
        best = {}
        for b in got[i].blocks:
            best[b.label] = max(b.share, best.get(b.label, 0.0))
        assert best == found(text), text
        assert set(got[i].labels.split(",")) - {""} == set(best) | (set(got[i].base_labels.split(",")) - {""})


def test_templates_of_more_than_64_words():
    template = " ".join(f"t{i}" for i in range(150))
    words = license_scan.vocabulary([("long", template)])
    of = license_scan.index([("long", template)], words, np.zeros(len(words), np.int64), 90)
    texts = pa.array(["x " * 5 + template.replace(" ", "\n") + " y", "x", template.replace("t1 ", "no ").replace(" ", "\n")])
    hashes, _, text, first, _ = license_scan.scan_words(texts)
    got = list(license_scan.windows(license_scan._places(hashes, words), text, first, of))
    assert sorted(got) == [(5, "long", 1.0), (157, "long", 149 / 150)]


def test_scattered_words_are_no_license(spark):
    """A line of 20,000 words that holds all words of a template far apart says nothing."""
    r, texts = random.Random(5), []
    for _, template in license_scan.TEMPLATES:
        words = [f"w{r.randrange(5000)}" for _ in range(20_000)]
        for k, word in enumerate(words_of(template)):
            words[100 + k * 150 % 19_000] = word
        texts.append(" ".join(words))
    got = scanned(spark, texts)
    assert all(not row.blocks and row.labels == row.base_labels for row in got.values())
