"""Encoding of a corpus with a public byte-level BPE vocabulary, without special tokens.

Texts up to ``LONG`` characters are encoded as they are, in Arrow batches. Longer texts are
taken apart, encoded in parallel and put together again:

* They are cut where the tokenizer's own pattern must cut: between character classes that no
  piece of the pattern can span, whatever follows. The class of a character is what the
  tokenizer's own engine says of it, so it does not matter which version of Unicode that knows.
* A run that the pattern keeps in one piece (a long line of signs, letters without spaces) has
  no such place. It is halved until the halves are short, the halves are encoded in parallel,
  and neighbours are joined pairwise, as a tree: a window of tokens around the join is encoded
  again, and grows until the tokens at both of its edges agree exactly with their neighbours.
  A sequence of BPE tokens is the encoding of its text if every two neighbours are the
  encoding of theirs, so the joined sequence is the one a single pass gives.

Defined cases: empty and null texts give an empty list; strings that look like special tokens
are ordinary text; a run of any length is encoded whole; repeated rows give repeated rows;
other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.common import ship

# Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters above which a text is taken apart, and of one part.
LONG, PART = 16_384, 8_192
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TEXT, HEAD, TAIL = 0, 1, 2  # a part to be encoded as text; the first and the later halves of one piece
LETTER, DIGIT, SIGN, SPACE, QUOTE = range(5)


@lru_cache(maxsize=4)
def encoder(path: str):  # noqa: ANN201
    """The vocabulary file as an encoder; once for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(enc, text: str) -> np.ndarray:  # noqa: ANN001
    return enc.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int32)


def encode_piece(enc, raw: bytes) -> list[int]:  # noqa: ANN001
    """Tokens of one piece of the pattern."""
    return enc._core_bpe.encode_single_piece(raw)


@lru_cache(maxsize=1)
def _probes() -> list[tuple[int, object]]:
    """One encoder for each class, which encodes a character if the tokenizer's own engine counts it to the class."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    return [(k, tiktoken.Encoding(f"class{k}", pat_str=p, mergeable_ranks=single, special_tokens={})) for k, p in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}"))]


@lru_cache(maxsize=200_000)
def _kind(code: int) -> int:
    c = chr(code)
    if c == "'":
        return QUOTE
    return next((k for k, probe in _probes() if probe.encode_ordinary(c)), SIGN)


def kinds(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    uniq, inv = np.unique(codes, return_inverse=True)
    return np.array([_kind(int(u)) for u in uniq], np.uint8)[inv] if len(uniq) else np.zeros(0, np.uint8)


def cuts(k: np.ndarray) -> np.ndarray:
    """Positions at which every reading of the pattern ends one piece and begins another."""
    a, b = k[:-1], k[1:]
    word = (a == LETTER) | (a == DIGIT)
    ok = (b == SPACE) & (word | (a == SIGN) | (a == QUOTE))
    ok |= (a == LETTER) & (b == DIGIT) | (a == DIGIT) & (b == LETTER)
    ok |= word & ((b == SIGN) | (b == QUOTE))
    ok |= (a == SIGN) & ((b == LETTER) | (b == DIGIT))
    return np.flatnonzero(ok) + 1


def halves(a: int, b: int, size: int) -> list[tuple[int, int]]:
    if b - a <= size:
        return [(a, b)]
    m = (a + b) // 2
    return halves(a, m, size) + halves(m, b, size)


def take_apart(text: str, size: int = PART) -> list[tuple[int, str]]:
    """``(kind of part, text)`` in order; the texts add up to the whole."""
    k = kinds(text)
    at = np.append(cuts(k), len(text))
    parts: list[tuple[int, str]] = []

    def piece(a: int, b: int) -> None:
        for i, (x, y) in enumerate(halves(a, b, size)):
            parts.append((TAIL if i else HEAD, text[x:y]))

    pos = 0
    while pos < len(text):
        i = int(np.searchsorted(at, pos + size, "right")) - 1
        end = int(at[i]) if i >= 0 and at[i] > pos else int(at[i + 1])
        if end - pos <= size:
            parts.append((TEXT, text[pos:end]))
            pos = end
            continue
        # no place to cut: leading white space, then at most one kind of characters
        run = k[pos:end]
        lead = int(np.argmax(run != SPACE)) if (run != SPACE).any() else len(run)
        rest = run[lead:]
        same = len(rest) and (np.isin(rest, (SIGN, QUOTE)).all() if rest[0] in (SIGN, QUOTE) else rest[0] in (LETTER, DIGIT) and (rest == rest[0]).all())
        if not len(rest) and end == len(text):
            piece(pos, end)
        elif same:
            body = pos + lead
            if lead > 1:
                piece(pos, body - 1)
            if lead and text[body - 1] == " ":
                body -= 1
            elif lead:
                parts.append((TEXT, text[body - 1]))
            piece(body, end)
        else:
            parts.append((TEXT, text[pos:end]))
        pos = end
    return parts


def join(enc, left: list[int], right: list[int]) -> list[int]:  # noqa: ANN001
    """Encoding of one piece from the encodings of its two halves."""
    raw = enc.decode_single_token_bytes

    def agree(x: int, y: int) -> bool:
        return encode_piece(enc, raw(x) + raw(y)) == [x, y]

    w = 1
    while True:
        a, b = left[-w:], right[:w]
        mid = encode_piece(enc, b"".join(map(raw, a + b)))
        if (w >= len(left) or agree(left[-w - 1], mid[0])) and (w >= len(right) or agree(mid[-1], right[w])):
            return left[:-w] + mid + right[w:]
        w *= 2


def join_tree(enc, parts: list[list[int]]) -> list[int]:  # noqa: ANN001
    while len(parts) > 1:
        parts = [join(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


#: Characters encoded before a batch is handed on.
FLUSH = 2_000_000


def _encode_texts(path: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, ids, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = text.as_py()
                ids.append(encode(enc, s) if s else np.zeros(0, np.int32))
                keys.append(key)
                size += len(s or "")
                if size > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), _lists(ids)], ["doc_id", "ids"])
                    keys, ids, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), _lists(ids)], ["doc_id", "ids"])

    return run


def _take_apart(part: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                parts = take_apart(text.as_py(), part)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array([row] * len(parts), pa.int64()),
                        "doc_id": pa.array([key] * len(parts), batch.schema.field(1).type),
                        "n": pa.array(range(len(parts)), pa.int32()),
                        "kind": pa.array([k for k, _ in parts], pa.int32()),
                        "part": pa.array([t for _, t in parts], pa.string()),
                    }
                )

    return run


def _encode_parts(path: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [
                encode(enc, t) if k == TEXT else np.array(encode_piece(enc, t.encode()), np.int32)
                for k, t in zip(batch.column("kind").to_pylist(), batch.column("part").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n", "kind")), _lists(ids)], ["row", "doc_id", "n", "kind", "ids"])

    return run


def _put_together(path: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out = []
            for parts in batch.column(1):
                ids: list[np.ndarray] = []
                piece: list[list[int]] = []
                for p in [*parts.as_py(), {"kind": TEXT, "ids": []}]:
                    if p["kind"] != TAIL and piece:
                        ids.append(np.array(join_tree(enc, piece), np.int32))
                        piece = []
                    if p["kind"] == TEXT:
                        ids.append(np.array(p["ids"], np.int32))
                    else:
                        piece.append(p["ids"])
                out.append(np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(out)], ["doc_id", "ids"])

    return run


def encode_corpus(
    df: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, long: int = LONG, part: int = PART
) -> DataFrame:
    """``(ident, ids)``: one row for each row of ``df``."""
    ship(df.sparkSession)
    rows = df.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    size = F.coalesce(F.length("text"), F.lit(0))
    short = rows.where(size <= long).mapInArrow(_encode_texts(vocabulary), f"doc_id {kind}, ids array<int>")
    # a row number keeps rows with the same identifier apart
    big = rows.where(size > long).withColumn("row", F.monotonically_increasing_id())
    parts = big.select("row", "doc_id", "text").mapInArrow(_take_apart(part), f"row long, doc_id {kind}, n int, kind int, part string")
    ids = parts.repartition("row", "n").mapInArrow(_encode_parts(vocabulary), f"row long, doc_id {kind}, n int, kind int, ids array<int>")
    whole = ids.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "kind", "ids"))).alias("parts"))
    long_ids = whole.select("doc_id", "parts").mapInArrow(_put_together(vocabulary), f"doc_id {kind}, ids array<int>")
    return short.unionByName(long_ids).withColumnRenamed("doc_id", ident)
