from __future__ import annotations

import os
import random

import pytest

from millrace.llm import tokenize as t

pytestmark = pytest.mark.skipif(not os.path.exists(t.VOCABULARY), reason="no vocabulary files")


def whole(text, size):
    enc, out, piece = t.encoder(t.VOCABULARY), [], []
    parts = t.take_apart(text, size)
    assert "".join(p for _, p in parts) == text
    for kind, part in [*parts, (t.TEXT, "")]:
        if kind != t.TAIL and piece:
            out += t.join_tree(enc, piece)
            piece = []
        if kind == t.TEXT:
            out += t.encode(enc, part).tolist() if part else []
        else:
            piece.append(t.encode_piece(enc, part.encode()))
    return out


ALPHABET = ["a", "the", "ing", "#", "=", " ", "  ", "\n", "\t", "'", "'s", "'ll", "9", "12", "é", "中", "文", "あ", "١", "\u3000", "\xa0", "😀", "𝓧", "İ",
            "\r\n", "<|endoftext|>", "\u200b", "e\u0301", "\x1b", "...", "\u1c89", "\U0001f9ea"]


@pytest.mark.parametrize("seed", range(6))
def test_parts_join_to_the_encoding_of_the_whole(seed):
    rng = random.Random(seed)
    enc = t.encoder(t.VOCABULARY)
    for _ in range(250):
        kind = rng.random()
        if kind < 0.4:
            s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 300)))
        elif kind < 0.7:
            s = "".join(rng.choice(["ab", "th", "e", "in", "tion", "s"]) for _ in range(300))
        else:
            s = rng.choice(["\n", " ", "x", "'"]) + rng.choice(["#", "=-", "  ", "\n", "中文字", "'", "thethe", "7"]) * rng.randint(1, 300) + rng.choice(["", "a", " b", "\u3000", "'s"])
        assert whole(s, rng.choice([8, 32, 64])) == t.encode(enc, s).tolist()


def test_long_unsplit_texts():
    enc = t.encoder(t.VOCABULARY)
    for s in ("a" * 50_000, "=" * 30_001, " " * 20_000, "x " + "\n" * 20_000 + "y", "ab1/" * 9_000, "漢字" * 9_000, "😀" * 10_000, "\U0001f9ea\U0001fae8" * 5_000,
              "\u1c89" * 9_000, "\U00010d50\U0001e6c0" * 5_000, "\u3000\xa0" * 9_000, "e\u0301" * 9_000, "\x1b\x00\x85" * 5_000, "x\u200b" * 5_000):
        assert whole(s, 1_000) == t.encode(enc, s).tolist()


@pytest.mark.parametrize("text", ["😀" * 10_000, "\U0001fae8" * 9_000, "\u1c89" * 9_000, "\U0001df00" * 9_000, "\u3000" * 9_000])
def test_runs_of_newer_characters_are_halved(text):
    parts = t.take_apart(text, 1_000)
    assert max(len(p) for _, p in parts) <= 1_000 and "".join(p for _, p in parts) == text


def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(t.VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for s in ("Hello  world's\n\n", "<|endoftext|> x", "naïve 中文 ١٢", "'" * 40):
        assert other.encode(s, add_special_tokens=False).ids == t.encode(t.encoder(t.VOCABULARY), s).tolist()


def test_corpus(spark):
    rng = random.Random(1)
    long = "".join(rng.choice(["word ", "x" * 900, "#" * 700, "\n", "1", "é"]) for _ in range(80))
    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (4, long), (4, long), (5, "=" * 5000), (None, "a b"), (6, " \t ")]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, ids string, row int")
    got = t.encode_corpus(df, long=500, part=100).collect()
    enc = t.encoder(t.VOCABULARY)
    want = sorted((str(i), t.encode(enc, s).tolist() if s else []) for i, s in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert t.encode_corpus(df.limit(0)).count() == 0
