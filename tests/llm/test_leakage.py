from __future__ import annotations

import random
import re

import numpy as np
import pytest

from millrace.llm import leakage as lk


@pytest.mark.parametrize("sigma", [1, 2, 5, 40])
def test_index_against_brute_force(sigma):
    rng = random.Random(sigma)
    for _ in range(40):
        n = rng.randint(1, 300)
        seq = np.array([rng.randint(1, sigma) for _ in range(n)])
        index = lk.FMIndex(seq)
        for m in (1, 2, 5, 9):
            starts = [rng.randrange(n) for _ in range(5)]
            phrases = np.array([[int(seq[(s + k) % n]) for k in range(m)] for s in starts] + [[rng.randint(1, int(seq.max())) for _ in range(m)] for _ in range(5)])
            live, lo, hi = index.search(phrases)
            got = {int(a): sorted(index.locate(np.arange(b, c)).tolist()) for a, b, c in zip(live, lo, hi, strict=True)}
            for k, p in enumerate(phrases):
                assert got.get(k, []) == [i for i in range(n - m + 1) if (seq[i : i + m] == p).all()]


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = [x.lower() for x in re.findall("[A-Za-z0-9]+", text or "")]
        have = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for item, prompt in items:
            p = [x.lower() for x in re.findall("[A-Za-z0-9]+", prompt or "")]
            if item is not None and any(tuple(p[i : i + 12]) in have for i in range(len(p) - 11)):
                out.add((d, item))
    return out


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünïx", "a", "the", "K9"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([11, 12, 20, 40])))) for i in range(20)]
    items += [(50, items[3][1] + " more words"), (51, None), (52, ""), (None, items[4][1])]
    docs = [(1, None), (2, ""), (3, "word"), (4, "é" * 50)]
    for d in range(10, 120):
        text = say(rng.randint(0, 80))
        if rng.random() < 0.5:
            p = rng.choice(items)[1] or ""
            p = p.split()
            a = rng.randint(0, max(0, len(p) - 12))
            text[5:5] = [x.upper() for x in p[a : a + rng.choice([11, 12, 13, 30])]]
        docs.append((d, "".join(x + rng.choice([" ", "\n", ", ", " **", "—", "\x1b"]) for x in text)))
    return docs + docs[20:30], items


@pytest.mark.parametrize("seed", range(3))
def test_spans_in_shards_and_slices_of_any_size(seed, monkeypatch):
    docs, items = corpus(random.Random(seed))
    want = brute([(i, t) for i, (_, t) in enumerate(docs)], items)
    raw = [(t or "").encode() for _, t in docs]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    named = [x for x in items if x[0] is not None]
    blocks = [lk.Phrases(named[:5]), lk.Phrases(named[5:])]
    for size, shard in ((1 << 21, 10**6), (100, 50), (17, 13), (999, 100)):
        monkeypatch.setattr(lk.chunks, "__defaults__", (size,))
        got = lk.find_spans(data, off, lambda: blocks, shard)
        assert {(d, i) for d, i, _, _ in got} == want
        for d, _, a, b in got:
            assert len(re.findall("[A-Za-z0-9]+", raw[d][a:b].decode("latin-1"))) >= 12


def test_leaked(spark):
    docs, items = corpus(random.Random(9))
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    ev = spark.createDataFrame([(*r, "s") for r in items], "item_id long, prompt string, suite string")
    want = brute(docs, items)
    assert {tuple(r) for r in lk.leaked(df, ev).collect()} == want
    assert {tuple(r)[:2] for r in lk.leaked_spans(df, ev, shard=64, per_block=40).collect()} == want
    assert lk.leaked(df.limit(0), ev).count() == 0
    assert lk.leaked(df, ev.limit(0)).count() == 0


def test_one_index_a_shard_for_all_blocks(monkeypatch):
    docs, items = corpus(random.Random(4))
    raw = [(t or "").encode() for _, t in docs]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    blocks, made, plain = [lk.Phrases([x]) for x in items if x[0] is not None], [], lk.FMIndex
    monkeypatch.setattr(lk.chunks, "__defaults__", (300,))
    monkeypatch.setattr(lk, "FMIndex", lambda seq: (made.append(1), plain(seq))[1])
    lk.find_spans(data, off, lambda: blocks, 500)
    n, made[:] = len(made), []
    lk.find_spans(data, off, lambda: blocks[:1], 500)
    assert n == len(made) > 2 and len(blocks) > 10
