import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leakloom.llm import trie_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return trie_bpe.TrieBpe(f.read())


def same(own, library, texts):
    import numpy as np

    for text, (ids, decoded) in zip(texts, own.encode_batch(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert decoded == own.decode(ids) == library.decode(expected, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", " ", "\n", "n't", "'s", "Σ", "ς", "İ", "aaa", "1", "#", "\x1c", "\x85", "ﬁ", "é", "한"]), max_size=20).map("".join), max_size=4))
def test_ids_and_text_are_the_library_s(own, library, texts):
    same(own, library, texts)


def test_long_words_and_forgetting(own, library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "REMEMBERED", 10)
    same(own, library, ["ab" * 3000, "x" * 5000 + " " + "banana" * 50, *["some words " + str(k) for k in range(30)]])


def test_prefixes_are_shared(own):
    words = [b"sharing", b"shared", b"share", b"sharing"]
    found = dict(own.encode_words(words))
    assert found[0] == found[3] and set(found) == {0, 1, 2, 3}


def test_awkward_documents(spark, awkward, nothing, library):
    from collections import Counter

    rows = trie_bpe.encode(awkward, PATH).collect()
    assert len(rows) == awkward.count()
    expected = Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in awkward.collect())
    import numpy as np

    assert Counter((r["id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == expected
    assert trie_bpe.encode(nothing, PATH).count() == 0
