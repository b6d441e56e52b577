"""Texts are cut into pieces that stay the same beside other signs and lines."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from vigil.llm import token_store
from vigil.llm.bpe import regular, split_pattern

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    tok = Tokenizer.from_file(PATH)
    return [np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_words_that_meet_at_a_line_or_sign_are_no_new_pieces():
    words = ["".join(random.Random(i).choices("abcdefgé", k=7)) for i in range(60)]
    texts = ["first " + " ".join(f"{a}{between}{b}" for a in words for b in words)
             for between in (".\n", "/", "\n\n", " (")]
    enc = token_store.PieceEncoder(PATH)
    assert enc.encode(texts) == library(texts)
    assert len(enc.known) + len(enc.loose) <= 2 * len(words) + 9


def test_cuts_are_ends_of_the_pattern():
    rng, pattern = random.Random(3), split_pattern(public_tokenizers.PATTERN)
    signs = list("ab'st.,(1 2\n\n\néÉ×÷ǅɏȿʰ日́²’😀\x00\x7f") + ["'s", "'re", "word"]
    texts = [""]
    while len(texts) < 3000:
        t = "".join(rng.choices(rng.sample(signs, rng.randint(1, 9)), k=rng.randint(0, 14)))
        texts += [t] * regular(t)
    all_texts = pa.array(["left out", *texts, ""], pa.string())
    pieces, bounds = token_store.pieces_of(all_texts.slice(1))
    pieces = pieces.to_pylist()
    for t, a, b in zip([*texts, ""], bounds, bounds[1:]):
        assert "".join(pieces[a:b]) == t
        assert [w for p in pieces[a:b] for w in pattern.findall(p)] == pattern.findall(t), repr(t)


def test_long_pieces_are_forgotten_by_their_ids(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED_IDS", 200)
    monkeypatch.setattr(token_store, "TEXT_BLOCK", 100)
    enc = token_store.PieceEncoder(PATH)
    texts = [f"a {i} " + "日本語" * 30 + chr(0x4E00 + i % 9) for i in range(40)] * 2
    assert enc.encode(texts) == library(texts)
    assert len(enc.known.ids) + len(enc.known.old.ids) < 2000
