"""Every operator and stage on odd rows: a defined result, and the same with columns of clashing names."""

import binascii
import hashlib
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepfold.llm import fingerprint, license_scan, line_dedup, mixing, near_dedup, packing, quality, token_cache, toxicity, url_reputation
from stepfold.llm.queries import tokenizer_file
from stepfold.plans.lineage import scratch
from tests.llm.conftest import ROWS

WORDS, PIECES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")


def operators(spark):
    labels = spark.createDataFrame([(4, 1), (7, 0), (8, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    return {
        "quality": lambda d: quality.judge(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
        "packing": lambda d: packing.pack(d, WORDS, group=4).select("doc_id", "piece", "start", "length", "ids_crc32"),
        "near_dedup": near_dedup.groups,
        "mixing": lambda d: mixing.mix(d).select("doc_id", "source", "text", "copy", "repeats"),
        "fingerprint": fingerprint.fingerprints,
        "license": license_scan.scan,
        "tokens": lambda d: token_cache.counted(d, PIECES, scratch(spark, "cache")).select("doc_id", "n_bytes", "n_tokens"),
        "lines": line_dedup.later_matches,
        "toxicity": lambda d: toxicity.scored(d, toxicity.train(d, labels)),
    }


NAMES = ["quality", "packing", "near_dedup", "mixing", "fingerprint", "license", "tokens", "lines", "toxicity"]
#: Rows per row of input, where the operator says so.
ONE_EACH = {"quality", "near_dedup", "fingerprint", "license", "tokens", "toxicity"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, edge, clashing, none, name):
    run = operators(spark)[name]
    rows = Counter(map(str, run(edge).collect()))
    assert rows == Counter(map(str, run(clashing).collect()))
    if name in ONE_EACH:
        assert sum(rows.values()) == len(ROWS)
    assert run(none).isEmpty()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_rows(spark, edge, clashing, none, k):
    stage = corpus_pipeline.STAGES[k][1]
    last = k == len(corpus_pipeline.STAGES) - 1
    for docs in (edge, clashing, none):
        path = scratch(spark, "stage")
        stage(spark, docs, "").write.parquet(path)
        out = spark.read.parquet(path)
        assert last or out.columns == docs.columns
        assert docs is not none or out.isEmpty()


def test_quality_of_odd_rows(edge):
    got = {r.doc_id: r for r in quality.judge(edge).collect()}
    assert [got[i].n_words for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and not any(got[i].kept for i in (1, 2, 3, 4))
    assert (got[6].n_words, got[6].n_dup_lines, got[6].n_repeat_words, got[6].base_failed) == (12, 1, 12, True)
    assert got[5].kept and got[5].n_words == 60_000 and got[5].n_repeat_words == 0 and got[1].clean_text is None


def test_line_rules(spark):
    prose = "The river ran on past the mill."
    body = "\n".join(" ".join(f"word{i * 12 + k}" for k in range(12)) + "." for i in range(8))
    menu, shout, foot = "Home | News | Sport | Weather | Contact", "BUY!! NOW!! CHEAP!! PILLS!! HERE!!", "All rights reserved."
    rows = [(1, f"{menu}\n{body}\n{foot}"), (2, "\n".join([menu] * 20)), (3, "\n".join([shout] * 20) + "\n" + prose), (4, "$$$ %%% ab*** cd### " * 40),
            (5, body + "\n" + "a / b")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == body
    assert not got[2].kept and not got[3].kept and not got[4].kept
    assert got[5].clean_text == body + "\na / b"  # one separator is not a menu


def test_packing_places_every_piece(spark, edge):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    rows = packing.pack(edge, WORDS, capacity=64, max_documents=5, max_cost=64 * 64, group=7, keep_ids=True).collect()
    expected = Counter()
    for doc_id, text, *_ in ROWS:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = struct.pack(f"<{len(ids[k:k + 64])}I", *ids[k:k + 64])
            expected[doc_id, k // 64, k, len(part) // 4, binascii.crc32(part), part] += 1
    assert expected == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64 and len(places) <= 5 and sum(n * n for _, n in places) <= 64 * 64


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_is_near_the_bound(rule):
    import numpy as np

    lengths = np.random.default_rng(3).integers(1, 1500, 4000)
    bins, offsets = packing.best_fit(lengths, 2048, 2048, 2048 * 2048, rule)
    filled = np.bincount(bins, weights=lengths)
    assert filled.max() <= 2048 and len(filled) <= 1.02 * lengths.sum() / 2048 + 1
    tight, _ = packing.best_fit(lengths, 2048, 2, 2048 * 700)
    assert np.bincount(tight).max() <= 2
    assert np.bincount(tight, weights=lengths.astype(float) ** 2).max() <= max(2048 * 700, 0) or lengths.max() ** 2 > 2048 * 700


def test_tokens_are_cached(spark, edge):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = scratch(spark, "cache")
    for docs in (edge.limit(4), edge, edge):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_cache.counted(docs, PIECES, cache).collect())
    assert got == Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in ROWS)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in ROWS})  # nothing twice


def test_tokens_of_a_json_file(spark, edge):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    got = Counter((r.doc_id, r.n_tokens) for r in token_cache.counted(edge, path, scratch(spark, "cache")).collect())
    assert got == Counter((i, len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS)


def test_word_encoder_equals_the_tokenizer():
    import random

    import numpy as np

    from stepfold.llm.tokens import WordEncoder

    encode, r = WordEncoder(WORDS), random.Random(5)
    letters = "aéÉßÀ'sStTdDlLvVeEmM<|>endoftxt019 \t\n İΣσ́ſK!.,×÷ªÿŸ日本🙂\x1c\x85%$"
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert encode.tokenizer.encode(text, add_special_tokens=False).ids == np.frombuffer(encode(text.encode()), "<u4").tolist()


def test_edited_text_and_likeness(spark):
    texts = {1: "One two. Three four. Five six.\nSeven eight.", 3: "x", 2: "Nine ten eleven twelve.\nThirteen.", 1025: "", 5000: "One two. Three four. Five six.\nSeven eight."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    ids = sorted(texts)
    for i, following in zip(ids, ids[1:] + ids[:1]):
        text, q = texts[i], len(texts[i]) // 4
        edited = text[:len(text) - q] + texts[following][:q]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
    assert got[1].fingerprint == got[5000].fingerprint and got[5000].near_next == 1.0 and got[1].near_next == 0.0
    assert 0 < got[1].near_edited < 1
    one = fingerprint.fingerprints(docs.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_sketches_recover_the_difference():
    import numpy as np

    r = np.random.default_rng(1)
    keys = r.integers(1, 2**63, 900, dtype=np.uint64)
    owner = np.repeat(np.arange(3), 300)
    a, b = (keys, owner), (np.concatenate([keys[:250], keys[300:600]]), np.repeat([0, 1], [250, 300]))
    assert fingerprint.likeness(a, b, 3).round(4).tolist() == [round(250 / 300, 4), 1.0, 0.0]


def test_licenses(spark):
    rows = [(1, "x\nReleased under the MIT License."), (2, "This work is licenced under the GNU General Public License version 3"), (3, "CC, by\nccby cc\nby"),
            (4, "the and of under by version work public license"), (5, "All rights\nreserved cc-by-nc 4.0 licensed under")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[1].score == 1.0 and got[1].blocks[0].line == 1
    assert (got[2].base_labels, got[2].first_word, got[2].n_base) == ("gpl", 7, 1)
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 0, 3) and got[3].labels == "cc-by"
    assert got[4].labels == "" and got[4].score == 0 and got[4].first_word is None
    assert got[5].base_labels == "cc-by,reserved" and got[5].labels == "cc-by,cc-by-nc,reserved"


def test_urls(spark):
    urls = ["https://a.example.net/en/x?q#f", "http://example.net/EN/", "HTTP://Example.COM/de/1", "ftp://notexample.com/de/1", "x.org/fr/", None, "http://x.org/fr/a?b",
            "http://net/", "http://net", "http://U:p@b.net:80?x", "a://b://c/d", "://\nx.net/\n/y?z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("rule", F.lit(1))
    bad = spark.createDataFrame([(3, 1)] * 90 + [(6, 1)] * 90 + [(10, 0)] * 300 + [(None, 1), (10, None)], "page_id long, bad int")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, bad, url_reputation.RULES).orderBy("page_id").collect()]
    assert got == [("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/EN/", "net/", "block"), ("example.com", "/de/1", "example.com/de/", "block"),
                   ("notexample.com", "/de/1", None, "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("x.org", "/fr/a", "org/fr/", "allow"),
                   ("net", "/", "net/", "block"), ("net", "", None, "allow"), ("u:p@b.net:80", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("\nx.net", "/\n/y", "net/", "block")]
    assert url_reputation.judge(pages.limit(0), bad.limit(0)).isEmpty()
    # Repeated and null page ids, a very long url: a row each, judged by its host.
    again = pages.union(pages).union(spark.createDataFrame([(None, "http://notexample.com/de/1"), (None, None), (99, "http://" + "a." * 500_000 + "org/fr/" + "b" * 500_000)], "page_id long, url string")
                                     .withColumn("host", F.lit("x")).withColumn("rule", F.lit(1)))
    rows = url_reputation.judge(again, bad, url_reputation.RULES).collect()
    assert len(rows) == 2 * len(urls) + 3 and {r.verdict for r in rows if r.host == "notexample.com"} == {"block"} and [r.rule for r in rows if r.page_id == 99] == ["org/fr/"]


def test_host_verdicts_follow_the_corpus(spark):
    """A host is blocked where it is probably worse than the rest; its domain and public suffix lend their weight."""
    groups = {"a.bad.co.uk": (40, 30), "b.bad.co.uk": (0, 0), "good.co.uk": (40, 4), "x.org": (60, 15), "y.org": (4, 2), "one.com": (1, 1)}
    rows, seen = [], []
    for host, (n, bad) in groups.items():
        for k in range(max(1, n)):
            rows.append((len(rows), f"http://{host}/{k}"))
            if n:
                seen.append((len(rows) - 1, int(k < bad)))
    got = {r.host: r for r in url_reputation.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(seen, "page_id long, bad int")).collect()}
    p = (52 + 1) / (145 + 2)
    suffix = (34 + 20 * p) / (80 + 20)
    domain = (30 + 20 * suffix) / (40 + 20)
    host = (30 + 20 * domain) / (40 + 20)
    assert got["a.bad.co.uk"].host_mean == pytest.approx(host) and got["b.bad.co.uk"].host_mean == pytest.approx(domain)
    assert {h for h, r in got.items() if r.verdict == "block"} == {"a.bad.co.uk", "b.bad.co.uk"}


def test_mixing_meets_its_targets(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("abcdefghij").alias("text"),
                                    F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 30 == 1, None).otherwise("y").alias("source"))
    out = mixing.mix(docs, weights={"x": 1.0, None: 2.0, "y": 1.0})
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(got["x"] - 2250) < 200 and abs(got[None] - 4500) < 250 and abs(got["y"] - 2250) < 200
    per = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("repeats").alias("r"), F.countDistinct("copy").alias("c"))
    assert per.filter("n <> r OR n <> c").isEmpty()
    ids = [r.doc_id for r in out.limit(200).collect()]
    assert ids != sorted(ids)


def test_poisson_of_a_large_mean(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    rate = spark.createDataFrame([("s", 100.0)], "source string, rate double")
    n = [r.n for r in mixing.repeated(docs, rate).groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    mean = sum(n) / len(n)
    assert abs(mean - 100) < 2.5 and abs(sum((x - mean) ** 2 for x in n) / len(n) - 100) < 30
