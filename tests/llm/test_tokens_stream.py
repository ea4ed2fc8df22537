import random

import pytest
import tokenizers
from public_tokenizers import path

from hydrolens.llm import tokens as T

FILE = path("byte_bpe_50k.json")
SAMPLES = {
    "letters": "日本語の文章には空白がありません" * 6000,
    "sentences": "日本語の文。空白、なし！" * 8000,
    "base64": "aGVsbG8gd29ybGQ+Lz09QUJD0123" * 3000,
    "digits": "31415926535" * 6000,
    "signs": "=-_*'s!?" * 10000,
    "blanks": "a" + " " * 30000 + "b" + "\n \t" * 9000 + " x" + "\n" * 20000 + "'s  ",
    "joined": " " + "ab" * 20000 + "'re" + "é" * 9000 + "12" * 5000 + "'" * 7000 + "s",
}


@pytest.fixture(scope="module")
def public():
    return tokenizers.Tokenizer.from_file(FILE)


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("size", [997, 65536])
def test_ids_come_early_and_little_is_kept(public, name, size):
    text = SAMPLES[name]
    v, memo = T.vocabulary(FILE)
    encoder, out, kept = T.Encoder(v, memo), [], 0
    for at in range(0, len(text), size):
        out += encoder.feed(text[at:at + size])
        kept = max(kept, len(encoder.rest) + len(encoder.open))
    early = len(out)
    out += encoder.end()
    assert out == public.encode(text, add_special_tokens=False).ids
    assert kept <= 4 * (T.OPEN + v.reach) and (early > 0.5 * len(out) or name == "blanks")


def test_any_pieces_give_the_same_ids(public):
    rng = random.Random(3)
    bits = ["日本", "語" * 3000, "a" * 5000, " ", "  ", " " * 4500, "\n", "\t" * 4200, "'", "'r", "'ll", "e", "1" * 4100, "١٢", "!", "=" * 4300, "é", " ", "　" * 4100, "😀" * 2100, "x y"]
    v, memo = T.vocabulary(FILE)
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        encoder, out, at = T.Encoder(v, memo), [], 0
        while at < len(text):
            to = at + rng.choice([1, 2, 3, 700, 4096, 4097, 9000])
            out += encoder.feed(text[at:to])
            at = to
        assert out + encoder.end() == public.encode(text, add_special_tokens=False).ids
