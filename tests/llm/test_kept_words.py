"""Words that a worker keeps for one operator go when another one begins."""

from stepfold.llm import tokens
from stepfold.llm.queries import tokenizer_file


def test_words_kept_for_packing_are_dropped():
    path = tokenizer_file("word_bpe_49k.json")
    before = tokens.word_encoder(path)(b"Some words, some more")
    tokens.forget()
    assert tokens.word_encoder.cache_info().currsize == 0
    assert tokens.word_encoder(path)(b"Some words, some more") == before
