import random

import public_tokenizers
import pytest
from helpers import AWKWARD, documents
from tokenizers import Tokenizer

from feldspar.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a<|endoftext|>b <|startoftext|>", "ΑΣ ΑΣ İstanbul é 漢字かな 👩‍👩‍👧 I'LL don't\x00\x01 ﬁ ½ 12345", " aaaaaaaaaaaaaaaaabababababab" * 3,
    "'s't're ​﻿ İ", "<|endoftext|>", "<|endoftext|", "\x1c\x1d \x85 ", "é é", "\x00a\x00!!b", "A" * 5000,
]


@pytest.fixture(scope="module")
def both():
    return bpe.Bpe(PATH), Tokenizer.from_file(PATH)


def same(both, texts):
    own, library = both
    for text, ids, expected in zip(texts, own.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == expected.ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), text


def test_odd_texts(both):
    same(both, [t or "" for t in AWKWARD] + ODD)


def test_a_very_long_text_is_encoded_whole(both):
    rnd = random.Random(7)
    same(both, [" ".join("".join(rnd.choices("abcdeé' <|", k=rnd.randint(1, 9))) for _ in range(200_000)), "x" * 300_000])


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyzABCZ  \t\n\x0b\x1c\x1f\x7f'’0123456789!?#$*éÉßÿ×÷ªº²½ÀÖçsttrevmld<|>", "abéÉß'sreve !", "aabbab a"])
def test_random_texts(both, alphabet):
    rnd = random.Random(5)
    same(both, ["".join(rnd.choices(alphabet, k=rnd.randint(0, 80))) for _ in range(3000)])


def test_merges_wait_for_a_lower_rank_that_arises(both):
    """A merge at one place can make a pair of a lower rank next to a further place of the same rank."""
    own, library = both
    words = [t.replace("</w>", "") for t in list(own.ids)[600:9000:7] if t.replace("</w>", "").isascii()]
    rnd = random.Random(1)
    same(both, ["".join(rnd.choices(words, k=4)) for _ in range(4000)])


def test_pieces_are_kept_within_bounds(both, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 50)
    same((bpe.Bpe(PATH), both[1]), ["one two three four five six " * 3 + str(i) for i in range(100)])


def test_rows(spark, both):
    texts = [*AWKWARD, *ODD]
    ids = [None, 3, 3, *range(len(texts) - 3)]
    rows = bpe.encode(documents(spark, texts, ids), "word_bpe_49k.json", batch_chars=40).collect()
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in rows) == sorted(
        (str(i), tuple(e.ids), both[1].decode(e.ids, skip_special_tokens=False))
        for i, e in zip(ids, both[1].encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True)
    )
    digests = bpe.digest(bpe.encode(documents(spark, ["hello world"]), PATH)).collect()
    e = both[1].encode("hello world", add_special_tokens=False)
    assert tuple(digests[0])[1:] == bpe.reference_digest(e.ids, both[1].decode(e.ids, skip_special_tokens=False))
    assert bpe.encode(documents(spark, []), PATH).collect() == []
