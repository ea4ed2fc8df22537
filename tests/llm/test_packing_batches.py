"""Ids of many texts at once equal the public tokenizer's, text by text."""

import random

import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def both(texts):
    from hydrolens.llm import packing

    file = public_tokenizers.path("word_bpe_49k.json")
    public, own = tokenizers.Tokenizer.from_file(file), packing.WordIds(file)
    for _ in range(2):  # the second time words come from the memo
        offsets, ids = own.many(pa.array(texts, pa.string()), 2)
        assert offsets[0] == 0 and offsets[-1] == len(ids) and len(offsets) == len(texts) + 1
        for i, t in enumerate(texts):
            assert ids[offsets[i]:offsets[i + 1]].tolist() == public.encode(t, add_special_tokens=False).ids + [2], ascii(t)


def test_spaces_marks_and_added_tokens():
    both(["", " ", "  a  b ", "x y, Z.", "a\n\n b\t\r\nc", "tab\x0bvt", "don't 'tis x'S IT'S we'll\xb2", "3.14e10 [x] `a` {b} ~~ $%&/()=?+*# \\x \x00a a\x7fb",
          "<|endoftext|>x ab<|startoftext|> x|>y a<b", "\u0130stanbul \u03a3\u03b1\u03c2 Kelvin\u212a", "\u023a\u023e, \u018f.\u0186 \u01c4 \u0149 \xdf", "e\u0301a", ""])
    both([])
    both([""])


def test_random_letters_and_marks():
    rng = random.Random(3)
    letters = [chr(c) for c in range(1, 0x250)] + list("'<|>st.,  ") * 20
    both(["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)])


def test_small_memo(monkeypatch):
    from hydrolens.llm import packing

    monkeypatch.setattr(packing, "MEMO", 3)
    both(["one two three four, five. six", "six five four three two one", "seven seven eight-nine one"])
