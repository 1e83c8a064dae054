import random

import pytest
from tokenizers import Tokenizer as Library

from folio.llm import bpe
from folio.llm.queries import tokenizer_path

PARTS = ["a", "b", "Σ", "İ", "ß", "é", "é", "\x1c", "\x85", "\xa0", "　", "'", "s", "'LL", "1", "½", "²", "漢字", "한", "😀", " ", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "!", "_", "\x00", "﻿", "th", "ing", "'S"]


@pytest.fixture(scope="module")
def both():
    return bpe.Tokenizer(tokenizer_path()), Library.from_file(tokenizer_path())


def same(both, texts):
    ours, library = both
    for text, (packed, decoded) in zip(texts, ours.run(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.unpack(packed) == ids, text
        assert decoded.decode() == library.decode(ids, skip_special_tokens=False), text


def test_against_the_library(both):
    rng = random.Random(4)
    same(both, ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(3000)])


def test_long_words(both):
    rng = random.Random(5)
    same(both, ["ab" * 9000, "".join(rng.choices("abcde", k=20_000)), "x" * 33, "ab" * 16 + "c", "word " * 20_000])


def test_short_and_long_trees_agree(both):
    rng = random.Random(6)
    words = ["".join(rng.choices("theraingod", k=rng.randint(2, 32))) for _ in range(400)]
    tokenizer = both[0]
    for word, ids in zip(words, tokenizer.encode_words(words), strict=True):
        start = [int(x) for x in tokenizer.inner[list(word.encode())]]
        start[-1] = int(tokenizer.final[word.encode()[-1]])
        assert tokenizer.merge_long(start) == ids


def test_memory_of_words_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    tokenizer = bpe.Tokenizer(tokenizer_path())
    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} again" for i in range(300)]
    for text in texts:
        assert tokenizer.run([text]) == both[0].run([text])
    assert len(tokenizer.young) <= 60


def test_odd_rows(odd, none):
    rows = bpe.encode_decode(odd, tokenizer_path(), out="made").collect()
    by_id = {r.doc_id: r.made for r in rows}
    assert len(rows) == odd.count()
    for i in (100, 101, 102):
        assert (by_id[i].n_tokens, bytes(by_id[i].packed), by_id[i].decoded) == (0, b"", "")
    assert all(len(r.made.packed) == 4 * r.made.n_tokens for r in rows)
    assert bpe.encode_decode(none, tokenizer_path()).count() == 0
