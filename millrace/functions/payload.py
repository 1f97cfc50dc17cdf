"""Payloads that anyone can make again: a stream of digests by seed and counter, cut anywhere."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of one digest.
WIDTH = 16


def stream_slice(seed: Column, start: Column, length: Column) -> Column:
    """Bytes ``start`` to ``start + length`` of the stream of ``seed``; block n is the digest of ``seed:n``."""
    first, last = F.floor(start / WIDTH), F.floor((start + length - 1) / WIDTH)
    text = F.array_join(F.transform(F.sequence(first, last), lambda n: F.md5(F.concat_ws(":", seed.cast("string"), n.cast("string")))), "")
    cut = F.substring(text, ((start - first * WIDTH) * 2 + 1).cast("int"), (length * 2).cast("int"))
    return F.when(length > 0, F.unhex(cut)).otherwise(F.lit(b""))


def byte_at(seed: Column, n: Column) -> Column:
    """One byte of the stream, as a number."""
    return F.conv(F.hex(stream_slice(seed, n, F.lit(1))), 16, 10).cast("int")


def stream_bytes(seed: str, start: int, length: int) -> bytes:
    """The same outside of Spark."""
    first = start // WIDTH
    whole = b"".join(hashlib.md5(f"{seed}:{n}".encode()).digest() for n in range(first, (start + length - 1) // WIDTH + 1))
    return whole[start - first * WIDTH :][:length]


def with_repeats(df: DataFrame, offset: str, every: int, seed: int = 1) -> DataFrame:
    """About one row in ``every`` comes twice, one after the other: the same rows whenever it is run."""
    twice = F.pmod(F.xxhash64(F.lit(seed), F.col(offset)), F.lit(every)) == 0
    return df.withColumn("_copies", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copies")


def interleaved(df: DataFrame, key: str, order: str, seed: int = 1) -> Column:
    """A sort key that mixes the keys at random and keeps the order inside each: the share of its key's rows before a row, shaken."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    place = (F.row_number().over(w.orderBy(order)) - 1 + F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(order)), F.lit(1000)) / 1000) / F.count("*").over(w)
    return place
