"""Hard negatives, collocations and the SentencePiece codec against plain versions and on odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from stepfold.llm import collocations, hard_negatives, piece_codec
from stepfold.llm.queries import REGISTRY, table, tokenizer_file
from tests.llm import brute
from tests.llm.conftest import ROWS, long_text
from tests.llm.test_queries import SF_DIR

MODEL = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceCodec(MODEL)


def test_codec_of_random_texts(library, codec):
    rng = random.Random(11)
    pieces = list(codec.pieces)

    def text():
        kind = rng.random()
        if kind < 0.3:
            return "".join(rng.choice("aab  ▁\n\t<s>0é日🙂\0.") for _ in range(rng.randint(0, 30)))
        if kind < 0.7:
            return "".join(rng.choice(pieces) for _ in range(rng.randint(1, 8)))
        return "".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 15)))

    for value in [*(text() for _ in range(4000)), "", " ", "\n", "a" * 70_000, "ab" * 40_000 + " " + "=" * 3000, long_text(3000)]:
        ids = codec.encode(value)
        assert ids.tolist() == library.encode(value) and codec.decode(ids) == library.decode(ids.tolist())
    for _ in range(2000):
        ids = [rng.randint(0, rng.choice([300, 31_999])) for _ in range(rng.randint(0, 6))]
        assert codec.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_codec_in_slices(library, codec, monkeypatch):
    text = "  ".join(f"w{i}\n" * (i % 3) + "x" * (i % 40) for i in range(500))
    monkeypatch.setattr(piece_codec, "SLICE", 50)
    assert codec.encode(text).tolist() == library.encode(text) and codec.decode(codec.encode(text)) == text


def test_codec_query(spark, library):
    want = {}
    for r in table(spark, SF_DIR, "documents").collect():
        ids = [*library.encode(r.text or ""), 2]
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in REGISTRY["op13_piece_codec"](spark, SF_DIR).collect()} == want


def test_codec_of_odd_rows(spark, edge, clashing, none, library):
    odd = clashing.withColumns({"ids": F.lit("x"), "decoded": F.lit("x")})
    want = Counter((r[0], tuple([*library.encode(r[1] or ""), 2]), r[1] or "") for r in ROWS)
    for docs in (edge, odd):
        out = piece_codec.encoded(docs, MODEL)
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out.collect()) == want and out.columns == docs.drop("ids", "decoded").columns + ["ids", "decoded"]
    assert piece_codec.encoded(none, MODEL).isEmpty()
    assert [r.ids for r in piece_codec.encoded(edge.filter("doc_id = 4"), MODEL, end=False).collect()] == [library.encode("one")]


@pytest.mark.parametrize("most,width", [(300, 64), (5, 7), (1 << 20, 200), (1 << 24, 64), (1, 1), (0, 1)])
def test_residues_are_exact(most, width):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-most, most + 1, (40, width)), rng.integers(-most, most + 1, (90, width))
    a[0], b[0], b[1] = most, most, -most
    gemm = hard_negatives.Residues(most * most * width, width)
    assert (gemm.product(gemm.split(a), gemm.split(b)) == a @ b.T).all()


def plain_negatives(rows, every=50):
    """op11 by all scores."""
    fine = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = [math.floor(256 * x) for x in vector]
        row = ((label + 1) % 10 if vec_id % 7 == 0 else label, vector, v)
        fine[vec_id] = min(fine.get(vec_id, row), row)
    out = set()
    for a in (i for i in fine if i % every == 0):
        scores = sorted(((-sum(x * y for x, y in zip(fine[a][2], fine[i][2])), i) for i in fine if i != a))
        positives = [(i, -s) for s, i in scores if fine[i][0] == fine[a][0]][:5]
        for p, ps in positives:
            hard = [(i, -s) for s, i in scores if fine[i][0] != fine[a][0] and 50 * ps <= -100 * s <= 95 * ps][:3]
            out |= {(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(hard)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("cells", [None, 40])
def test_hard_negatives(spark, monkeypatch, cells):
    """Ties, equal vectors, a hot label, negative scores and ids; with small cells and tiles, too."""
    if cells:
        for name in ("ROWS", "LEAST_ROWS", "ANCHORS", "TILE", "STRETCH"):
            monkeypatch.setattr(hard_negatives, name, {"TILE": 3, "ANCHORS": 4, "STRETCH": 16}.get(name, cells))
    rng = np.random.default_rng(4)
    rows = [(i - 60, [float(np.float32(x)) for x in rng.integers(-3, 4, 5) / 4], int(rng.choice([0, 0, 0, 1, 2, 9]))) for i in range(500)]
    rows += [(1000 + i, [0.5, 0.5, 0.25, 0.0, 0.0], 3) for i in range(60)] + [(2000 + i, [0.25, 0.5, 0.25, 0.0, 0.0], 4) for i in range(60)]
    got = [tuple(r) for r in hard_negatives.mined(vectors(spark, rows)).collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == plain_negatives(rows)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 0.5], 1), (1, [1.0, 0.25], 2), (1, [1.0, 0.25], 2), (2, [0.5, 1.0], 2), (3, [0.75, 0.25], 1), (4, [0.5], 3),
            (5, [], 3), (6, [1.0, None], 2), (8, [1.0, nan], 2), (9, [inf, 1.0], 2), (10, None, 2), (11, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (50, [0.0, 0.0], 1), (100, [-1.0, -1.0], 4)]
    want = plain_negatives([(i, None if v is None else [*v, *[0.0] * (2 - len(v))], t) for i, v, t in rows])
    frame = vectors(spark, rows)
    odd = frame.withColumns({c: F.lit("x") for c in ("anchor_id", "v", "of", "vector", "score", "rank", "__part", "positives", "n")})
    for df in (frame, odd):
        assert Counter(tuple(r) for r in hard_negatives.mined(df).collect()) == Counter(want)
    assert want and hard_negatives.mined(vectors(spark, [])).isEmpty() and hard_negatives.mined(frame.filter("vec_id % 50 <> 0")).isEmpty()
    with pytest.raises(ValueError):
        hard_negatives.mined(vectors(spark, [(0, [3e8], 1)]))


def test_word_index():
    rng = np.random.default_rng(2)
    for n, most, depth in ((0, 3, 5), (1, 3, 5), (50, 3, 5), (2000, 6, 5), (2000, 40, 4), (3000, 2, 3), (500, 5, 2)):
        seq = collocations._pieces(rng.integers(0, most + 1, n).astype(np.int32))
        s = seq.tolist()
        want = Counter(tuple(s[i:i + k]) for k in range(2, depth + 1) for i in range(len(s) - k + 1) if 0 not in s[i:i + k])
        got = Counter()
        for ids, counts in collocations.WordIndex(seq, depth).phrases():
            got.update(dict(zip(map(tuple, ids.tolist()), counts.tolist())))
        assert got == want


def plain_collocations(docs, least, top):
    """op12 by counting every phrase."""
    import re

    f, total = {}, Counter()
    for lang, text in docs:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            own.update(tuple(words[i:i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        inside = {(p[i:j], a) for p, a in frequent.items() if len(p) > 2 for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}
        rows = []
        for p, a in frequent.items():
            if len(p) > 1 and (p, a) not in inside:
                score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for n, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top]):
            out.add((lang, n + 1, phrase.decode(), -a, left, right, total[lang], -score))
    return out


@pytest.mark.parametrize("shard", [collocations.SHARD, 60])
def test_collocations(spark, monkeypatch, shard):
    """Overlaps, ties, phrases inside others, hot words, several languages; in one shard and in many, in slices of a few bytes."""
    monkeypatch.setattr(collocations, "SHARD", shard)
    if shard == 60:
        monkeypatch.setattr(collocations, "SLICE", 7)
    rng = random.Random(3)
    words = ["the", "of", "A", "b", "Ä", "日本", "ne\x00w", "york", "x" * 300]
    def text():
        return "".join(rng.choice(["new york city ", "a a a a a ", "the of ", *[f"{w}{rng.choice(' ' * 6 + chr(9) + ',.;!?' + chr(10) + chr(13))}" for w in words]]) for _ in range(rng.randint(0, 60)))
    docs = [(rng.choice(["en", "en", "de", None, "und"]), text()) for _ in range(150)] + [("en", None), (None, ""), ("fr", "one two"), ("en", " , \t.\n")]
    frame = spark.createDataFrame(docs, "lang string, text string")
    for least, top in ((5, 2000), (20, 7)):
        got = [tuple(r) for r in collocations.collocations(frame, least, top).collect()]
        want = plain_collocations(docs, least, top)
        assert len(want) > 10 and len(got) == len(set(got)) and set(got) == want


def test_collocations_of_odd_rows(spark, edge, clashing, none):
    odd = clashing.withColumns({c: F.lit("x") for c in ("shard", "ids", "word", "range", "data", "f", "n", "id", "name")})
    want = plain_collocations([(r[2], r[1]) for r in ROWS], 2, 2000)
    for docs in (edge, odd):
        assert {tuple(r) for r in collocations.collocations(docs, 2).collect()} == want
    assert want and collocations.collocations(none).isEmpty()
