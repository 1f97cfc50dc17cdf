"""Evaluation texts leaking into training text.

The corpus is cut into shards of words, and each shard gets an FM-index over its word
sequence: suffix array, Burrows-Wheeler transform in a wavelet matrix with rank counts, and
sampled suffix positions. Every phrase of ``WINDOW`` successive words of an evaluation item is
searched backward through the index; occurrences are located by walking to the next sampled
position, checked against the text itself, and overlapping ones are merged to removal spans.

Words are runs of ASCII letters and digits, case ignored; anything else only separates words.
In the index a word is a 64-bit hash; two words with the same hash cannot leave a match out,
and the check against the text takes out what they could add.

Defined cases: null and empty texts and items have no words; items of fewer than ``WINDOW``
words match nothing; a phrase that fits several items counts for each; texts longer than a
shard are indexed in pieces that overlap by ``WINDOW - 1`` words; repeated rows give one result
for each identifier; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.common import ship

WINDOW = 12
#: Bytes of text read at a time and words of one shard.
SLICE, SHARD = 1 << 21, 400_000
#: Every so many suffix positions one is kept.
SAMPLE = 32
#: Phrases of one block, which bounds what is sent to the tasks at a time, and shards that are asked together.
PHRASES, HELD = 500_000, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isalnum() and _c < 128:
        _LOWER[_c] = ord(chr(_c).lower())


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.full(n, _ODD, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def words(buf: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end bytes of the words of ``buf``; no word spans a break."""
    low = _LOWER[buf]
    inside = low > 0
    edge = np.zeros(len(buf) + 1, bool)
    edge[breaks] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _powers(1 << max(SLICE.bit_length(), int(len(buf)).bit_length()))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * up[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29)), starts, ends


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence that ends in its unique least symbol; doubles only what is still tied."""
    n, sigma = len(t), int(t.max()) + 1
    step = 3 if sigma < 1 << 20 else 1
    key = t.astype(np.int64)
    for k in range(1, step):
        key = key * (sigma + 1)
        key[: n - k] += t[k:] + 1
    sa = np.argsort(key)
    key = key[sa]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = step
    while len(tied):
        sub = sa[tied]
        key = rank[sub] * (n + 1) + rank[np.minimum(sub + h, n)] + 1
        order = np.argsort(key)
        sub, key = sub[order], key[order]
        sa[tied] = sub
        new = np.empty(len(tied), bool)
        new[0] = True
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        rank[sub] = np.repeat(tied[first], np.diff(np.append(first, len(tied))))
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class FMIndex:
    """Backward search and location over a sequence of symbols from 1; 0 ends it."""

    def __init__(self, seq: np.ndarray):
        t = np.append(seq, 0)
        self.n = len(t)
        sa = suffix_array(t)
        bwt = t[sa - 1]
        count = np.bincount(t, minlength=int(t.max()) + 1)
        self.before = np.append(0, np.cumsum(count))
        self.bits = max(1, int(t.max()).bit_length())
        self.ones, self.zeros = [], []
        cur = bwt
        for level in range(self.bits - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            r = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=r[1:])
            self.ones.append(r)
            self.zeros.append(int(self.n - r[-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])
        self.kept = sa % SAMPLE == 0
        self.kept_before = np.append(0, np.cumsum(self.kept)).astype(np.int32)
        self.positions = sa[self.kept]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, r in enumerate(self.ones):
            one = r[at]
            at = np.where((symbol >> (self.bits - 1 - i)) & 1, self.zeros[i] + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs among the first ``at`` symbols of the transform."""
        return self._down(symbol, at) - self._down(symbol, np.zeros_like(at))

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for i, r in enumerate(self.ones):
            one = r[at]
            bit = r[at + 1] - one
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[i] + one, at - one)
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases found (row numbers), and their rows ``low <= row < high`` of the sorted suffixes."""
        live = np.arange(len(phrases))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            s = phrases[live, k]
            lo, hi = self.before[s] + self.rank(s, lo), self.before[s] + self.rank(s, hi)
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in ``rows``."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.kept[at]
            out[todo[hit]] = self.positions[self.kept_before[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            s = self.symbol(at)
            at = self.before[s] + self.rank(s, at)
            steps += 1
        return out


def plain_words(text: str | None) -> list[str]:
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text or "")]


class Phrases:
    """All phrases of ``WINDOW`` words of a block of items, each once, with the items that have it."""

    def __init__(self, items: list[tuple[int, str | None]]):
        found: dict[tuple[str, ...], list[int]] = {}
        for item, prompt in items:
            w = plain_words(prompt)
            for i in range(len(w) - WINDOW + 1):
                ids = found.setdefault(tuple(w[i : i + WINDOW]), [])
                if item not in ids:
                    ids.append(item)
        self.text = [" ".join(p).encode() for p in found]
        self.items = [np.array(v, np.int64) for v in found.values()]
        flat = np.frombuffer(b" ".join(self.text), np.uint8)
        self.hashes = words(flat, np.zeros(0, np.int64))[0].reshape(-1, WINDOW) if found else np.zeros((0, WINDOW), np.uint64)


class Shard:
    """The words of a shard under one index, made once and asked for any number of blocks of phrases."""

    def __init__(self, doc: np.ndarray, h: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.doc, self.begin, self.end = doc, begin, end
        self.uniq, ids = np.unique(h, return_inverse=True)
        shift = np.append(0, np.cumsum(doc[1:] != doc[:-1]))  # separators before each word
        seq = np.ones(len(h) + int(shift[-1]), np.int64)
        self.where = np.arange(len(h)) + shift
        seq[self.where] = ids + 2
        self.index = FMIndex(seq)

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of every occurrence; none spans two texts."""
        at = np.searchsorted(self.uniq, phrases.hashes)
        known = (self.uniq[np.minimum(at, len(self.uniq) - 1)] == phrases.hashes).all(axis=1)
        which = np.flatnonzero(known)
        live, lo, hi = self.index.search(at[which] + 2)
        many = hi - lo
        rows = np.repeat(lo - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(int(many.sum()))
        return np.repeat(which[live], many), np.searchsorted(self.where, self.index.locate(rows))


def chunks(data: np.ndarray, off: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size`` that end where a text ends or between two words."""
    pos, end = int(off[0]), int(off[-1])
    while pos < end:
        q = min(pos + size, end)
        if q < end:
            whole = int(off[np.searchsorted(off, q, "right") - 1])
            if whole > pos:
                q = whole
            else:
                gaps = np.flatnonzero(_LOWER[data[pos:q]] == 0)
                stop = int(off[np.searchsorted(off, pos, "right")])
                while not len(gaps) and q < stop:
                    gaps = np.flatnonzero(_LOWER[data[q : q + size]] == 0)
                    gaps, q = gaps[:1] + (q - pos), min(q + size, stop)
                q = pos + int(gaps[-1]) + 1 if len(gaps) else q
                q = min(q, stop)
        yield pos, q
        pos = q


def find_spans(data: np.ndarray, off: np.ndarray, blocks: Callable[[], Iterable[Phrases]], shard: int = SHARD) -> list[tuple[int, int, int, int]]:
    """(text number, item, first byte, end byte) of the merged spans of a batch of texts.

    ``data`` holds the texts one after another, ``off`` where each begins and the last ends;
    ``blocks`` hands out the blocks of phrases, once for every ``HELD`` shards.
    """
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    parts: list[tuple[np.ndarray, ...]] = []
    held: list[Shard] = []

    def ask() -> None:
        for phrases in blocks() if held else ():
            for x in held:
                phrase, first = x.search(phrases)
                for p, f in zip(phrase.tolist(), first.tolist(), strict=True):
                    a, b = int(x.begin[f]), int(x.end[f + WINDOW - 1])
                    if " ".join(plain_words(data[a:b].tobytes().decode("latin-1"))).encode() == phrases.text[p]:
                        for item in phrases.items[p].tolist():
                            spans.setdefault((int(x.doc[f]), item), []).append((a, b))
        held.clear()

    def flush(last: bool) -> list[tuple[np.ndarray, ...]]:
        doc, h, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        held.append(Shard(doc, h, begin, end))
        if last or len(held) >= HELD:
            ask()
        if last:
            return []
        keep = slice(max(len(h) - WINDOW + 1, int(np.searchsorted(doc, doc[-1]))), None)
        return [(doc[keep], h[keep], begin[keep], end[keep])]

    size = 0
    for lo, hi in chunks(data, off):
        breaks = off[(off > lo) & (off < hi)] - lo
        h, begin, end = words(data[lo:hi], breaks)
        if len(h):
            parts.append((np.searchsorted(off, begin + lo, "right") - 1, h, begin + lo, end + lo))
            size += len(h)
        if size >= shard:
            parts = flush(last=False)
            size = sum(len(x[0]) for x in parts)
    if parts:
        flush(last=True)
    ask()
    out = []
    for (doc, item), found in spans.items():
        found.sort()
        a, b = found[0]
        for x, y in [*found[1:], (1 << 62, 0)]:
            if x > b:
                out.append((doc, item, a - int(off[doc]), b - int(off[doc])))
                a, b = x, y
            b = max(b, y)
    return out


def _search(blocks: list[Broadcast], shard: int):  # noqa: ANN202
    def each() -> Iterator[Phrases]:
        for b in blocks:
            yield b.value
            if len(blocks) > 1:  # one block at a time in the worker; the next use reads it again
                b.__dict__.pop("_value", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).fill_null("").cast(pa.large_string())
            off = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            got = find_spans(data, off, each, shard) if len(text) and off[-1] > off[0] else []
            doc, item, a, b = zip(*got, strict=True) if got else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                ["doc_id", "item_id", "first_byte", "end_byte"],
            )

    return run


def leaked_spans(
    docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", prompt: str = "prompt",
    shard: int = SHARD, per_block: int = PHRASES,
) -> DataFrame:
    """``(doc_id, item_id, first_byte, end_byte)``: merged spans, in bytes of the UTF-8 text.

    One pass: the index of a shard is made once and all items are searched in it. Items go to the
    tasks as broadcast blocks of at most ``per_block`` phrases. The driver and a worker hold one
    block at a time in memory; blocks lie in files.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, first_byte long, end_byte long"
    sc, blocks, block, size = docs.sparkSession.sparkContext, [], [], 0
    phrase_count = F.greatest(F.size(F.split("p", "[^A-Za-z0-9]+")), F.lit(0))
    listed = items.select(F.col(item).cast("long").alias("i"), F.col(prompt).alias("p")).where("i IS NOT NULL AND p IS NOT NULL")
    for r in [None] if listed.isEmpty() else chain(listed.withColumn("n", phrase_count).toLocalIterator(), [None]):
        if block and (r is None or size + r["n"] > per_block):
            blocks.append(sc.broadcast(Phrases(block)))
            block, size = [], 0
        if r is not None:
            block.append((r["i"], r["p"]))
            size += r["n"]
    return rows.mapInArrow(_search(blocks, shard), schema).distinct() if blocks else rows.sparkSession.createDataFrame([], schema)


def leaked(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """``(doc_id, item_id)`` of every text that holds a phrase of an item."""
    return leaked_spans(docs, items, **names).select("doc_id", "item_id").distinct()
