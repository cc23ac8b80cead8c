import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def long_text(words: int = 60_000) -> str:
    return " ".join(f"w{i * 7919 % 100_003}" for i in range(words))


ROWS = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n\x0b ", "en", "a", 5), (4, "one", "en", "b", 3), (5, long_text(), "de", "a", 1),
    (6, "alpha beta gamma delta epsilon zeta\nalpha beta gamma delta epsilon zeta", None, "b", 2), (6, "alpha beta gamma delta epsilon zeta\nalpha beta gamma delta epsilon zeta", None, "b", 2),
    (7, "alpha beta gamma delta epsilon zeta", "en", None, 2), (8, "alpha beta gamma delta epsilon zeta\nalpha beta gamma delta epsilon zeta", "en", "b", 9),
    (None, "nobody knows the number of this text at all", "en", "a", 1), (9, "Ärger <|endoftext|> 日本 🙂 all rights reserved. CC-BY", "de", "c", 4),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHES = ("n_words word_chars kept base_failed lost_share clean_text copy repeats rate score predicted host path rule verdict label rep key "
           "digest sketch fine marks group piece salt line lines d1 first token size at bucket extra toxic n_tokens n_bytes component_id n_shingles").split()


@pytest.fixture(scope="session")
def clashing(edge):
    """The same with columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    return edge.withColumns({c: F.lit("x") for c in CLASHES})
