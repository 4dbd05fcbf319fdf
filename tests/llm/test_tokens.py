import random

import numpy as np
import pytest

from passagework.llm import tokens

CASES = [
    "", "a", " a", "  a", "a  b", "a \n b", "\n\n\n", "   ", "it's we'll 'd've IT'S", "x² ½kg 10³", "a_b __init__ _", "<|endoftext|> x",
    "tab\tand\x0bvt\x0cff\r\n", "\x1c\x1d x", "\x85\xa0 nbsp", "ñandú œuvre ß", "Ωμέγα", "Привет, мир", "日本語 text", "नमस्ते", "é combining",
    "emoji 😀 ok", "€5 – “q” … ‰", "a" * 5000, "0123456789" * 50, "!!!???...,,,", "ˇ˘ modifiers", "҂ ҃", "΢ unassigned", "   spaces", "­ soft",
]


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(tokens.default_path())


def test_agrees_with_the_library(enc):
    rng = random.Random(7)
    signs = "aZ '_-²½9.\n\t éßЖ€…sdtm\x85\xa0日"
    more = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for t in CASES + more:
        expected = enc.library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == expected, repr(t)


def test_added_tokens_agree_with_an_untouched_library(enc):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    assert np.frombuffer(enc.encode("x <|endoftext|> y"), "<u4").tolist() == [87, 220, 50256, 331]
    for t in ["<|endoftext|>", "a<|endoftext|>b  <|endoftext|>\n", "日本 <|endoftext|>x", "<|endoftext| >", "w " * 99 + "<|endoftext|>", *CASES]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_documents_end_with_the_end_id(enc):
    assert [d.tolist() for d in enc.documents([None, "", "a"])] == [[2], [2], [64, 2]]
    assert list(enc.documents([])) == []


def test_steps_segments_and_calls_change_nothing(enc, monkeypatch):
    rng = random.Random(5)
    long = ["".join(rng.choice("ab é1²,.'\n\t _日") for _ in range(3000)) for _ in range(4)]
    texts = [*CASES, *long, "x <|endoftext|> y " * 40, None, *(" ".join(f"w{k}x{i}" for i in range(15)) for k in range(30))]
    expected = [enc.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode_all(texts)] == expected
    for step, segment, call in [(1, 1, 1), (50, 20, 3), (400, 70, 10_000), (10**9, 9, 2)]:
        for name, value in [("STEP", step), ("SEGMENT", segment), ("CALL", call)]:
            monkeypatch.setattr(tokens, name, value)
        assert [x.tolist() for x in enc.encode_all(texts)] == expected


def test_long_texts_are_cut_at_sure_places(enc, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 40)
    text = "It's 3 o'clock, isn't it?  No\n\n  x1y2'll " * 30
    assert len(enc._segments(text)) > 10 and "".join(enc._segments(text)) == text
    assert enc._segments("ab" * 500) == ["ab" * 500]


def test_every_settled_character_alone_and_between(enc):
    for c in map(chr, range(1, 0x2100)):
        if tokens.SETTLED.fullmatch(c):
            t = f"a{c}b {c} 1{c}"
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.library.encode(t, add_special_tokens=False).ids, hex(ord(c))
