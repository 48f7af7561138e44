"""The cache of the word tokenizer knows pieces of words, and words split by Arrow are those of str.split()."""

import pytest

from tidemark.llm import packing

public = pytest.importorskip("public_tokenizers")


def test_pieces_that_are_known_words_are_not_merged_again(monkeypatch):
    path = public.path("word_bpe_49k.json")
    t, merged = packing.WordTokenizer(path), []
    real = t._merge
    monkeypatch.setattr(t, "_merge", lambda pieces: merged.extend(pieces) or real(pieces))
    texts = ["tidalish markings", " Tidalish,　markings's\n", "", " ", "a\x1cb tidalish", "\x85tidalish MARKINGS.", "''s été9 <w>"]
    got = [t.encode([x])[0] for x in texts] + t.encode(texts)
    assert got == t._raw(texts) * 2
    assert merged.count("tidalish") == merged.count("markings") == 1
