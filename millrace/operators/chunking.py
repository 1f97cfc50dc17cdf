"""Cutting substreams into chunks: by count, by size, by change, or by user logic.

Rows of a substream are numbered in two levels, over blocks of offsets and inside each block
(module ``blocks``), so a substream with most of the rows is numbered by many tasks; a chunk is
then one small group. Only the greedy size cut and user logic need the rows of a substream one
after another: they stream through sorted partitions and hold a few numbers of the open chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.common import ship
from millrace.envelope import ORDER, STREAM
from millrace.operators import blocks
from millrace.operators.stateless import Stage

def numbered(df: DataFrame, name: str = "rn", block: int = blocks.BLOCK) -> DataFrame:
    """Adds the position (from 0) of each row in its substream."""
    return blocks.running(df, STREAM, ORDER, F.lit(1), name, block=block)


def chunk_length(max_messages: int, counts_first: bool, exact: bool = False) -> int:
    """Rows of a full chunk. A buffer that counts its first message closes with the one after
    ``max_messages``; one that does not holds at least two. ``exact``: as many as documented."""
    return max_messages if exact else max_messages + 1 if counts_first else max(2, max_messages + 1)


def chunk_by_count(length: int, **aggregates: Column) -> Stage:
    """Chunks of ``length`` rows of each substream; the open last one is emitted at the end of input.

    Output: topic, partition, route, chunk, first_offset, offset (of the last row), n, is_open, and the aggregates.
    """

    def stage(df: DataFrame) -> DataFrame:
        d = numbered(df).withColumn("chunk", F.floor(F.col("rn") / length))
        return _emit(d, [*STREAM, "chunk"], aggregates).withColumn("is_open", F.col("n") < length)

    return stage


def _emit(d: DataFrame, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    return d.groupBy(*keys).agg(
        F.min("offset").alias("first_offset"), F.max("offset").alias("offset"), F.count("*").alias("n"),
        F.max("ord").alias("ord"), *[c.alias(k) for k, c in aggregates.items()],
    )


def chunk_by_change(is_break: Column, block: int = blocks.BLOCK, **aggregates: Column) -> Stage:
    """A row for which ``is_break`` holds closes the chunk before it and begins a new one.

    ``is_break`` may use columns of the row before, as ``with_previous`` adds them.
    """

    def stage(df: DataFrame) -> DataFrame:
        d = blocks.running(df, STREAM, ORDER, F.coalesce(is_break, F.lit(False)).cast("long"), "chunk", inclusive=True, block=block)
        return _emit(d, [*STREAM, "chunk"], aggregates)

    return stage


def with_previous(block: int = blocks.BLOCK, **columns: str) -> Stage:
    """Adds values of the row before in the same substream, by name."""
    return lambda df: blocks.previous(df, STREAM, ORDER, columns, block=block)


def in_chunk_order(*columns: str) -> Column:
    """Aggregate: the rows of a chunk in order, as an array of structs."""
    packed = F.array_sort(F.collect_list(F.struct(*ORDER, *columns)))
    return F.transform(packed, lambda x: F.struct(*[x[c].alias(c) for c in columns]))


def chunk_by_size(size: str, max_size: int, max_messages: int | None = None, counts_first: bool = True) -> Stage:
    """Greedy cut: a row closes its chunk when the sizes so far and its own reach ``max_size``, or
    ``max_messages`` rows came before it. ``counts_first``: the first row takes part in that test.

    Output as ``chunk_by_count``, with ``bytes``; ``is_open`` marks chunks cut off by the end of input.
    Null and negative sizes count as 0. Each cut depends on the one before, so a substream is read in one
    task, chunk by chunk: the place of the next cut is looked up in the running sums of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, n, held, first, last = None, 0, 0, 0, 0, 0  # of the open chunk: rows, sizes, ends

        def close(is_open: bool) -> tuple:
            return (key, number, first, last, n, held, is_open)

        def told(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["_key", *names])

        for batch in batches:
            keys, offset = batch.column("_key"), batch.column("offset").to_numpy()
            sums = np.append(0, np.cumsum(batch.column("_size").to_numpy()))
            codes = keys.dictionary_encode()
            where = codes.indices.to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(where)]]) if len(where) else [0]
            out = []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                k = codes.dictionary[int(where[a])].as_py()
                if k != key:
                    if n:
                        out.append(close(True))
                    key, number, n, held = k, 0, 0, 0
                pos = int(a)
                while pos < z:
                    first = first if n else int(offset[pos])
                    if not n and not counts_first:
                        n, last, pos = 1, int(offset[pos]), pos + 1
                        continue
                    end = int(np.searchsorted(sums, sums[pos] + max_size - held)) - 1  # the row that reaches the size
                    end = max(end, pos)
                    if max_messages is not None:
                        end = min(end, pos + max(0, max_messages - n))
                    stop = min(end, int(z) - 1)
                    n, held, last = n + stop - pos + 1, held + int(sums[stop + 1] - sums[pos]), int(offset[stop])
                    pos = stop + 1
                    if end < z:
                        out.append(close(False))
                        number, n, held = number + 1, 0, 0
            yield told(out)
        if n:
            yield told([close(True)])

    names = ["chunk", "first_offset", "offset", "n", "bytes", "is_open"]
    types = [pa.string(), *[pa.int64()] * 5, pa.bool_()]
    keyed = "struct<topic:string,partition:int,route:array<string>>"

    def stage(df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        rows = df.select(
            F.to_json(F.struct(*STREAM), {"ignoreNullFields": "false"}).alias("_key"), *ORDER,
            F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size"),
        )
        rows = rows.repartition("_key").sortWithinPartitions("_key", *ORDER).select("_key", "offset", "_size")
        out = rows.mapInArrow(run, "_key string, chunk long, first_offset long, offset long, n long, bytes long, is_open boolean")
        return out.select(F.from_json("_key", keyed).alias("_k"), *names).select("_k.*", *names)

    return stage


class Exit(NamedTuple):
    """A result after which the substream's logic is closed and forgotten; the next row starts a new one."""

    row: tuple


class Aggregate:
    """User logic of a substream: ``add`` says keep, flush (with this row) or reject (before this row);
    ``result`` makes the output row, an ``Exit`` with it, or None to refuse and keep waiting."""

    def add(self, offset: int, row: NamedTuple) -> str:
        raise NotImplementedError

    def result(self) -> tuple | Exit | None:
        raise NotImplementedError

    def close(self) -> None:
        """Called when the logic is forgotten or the input ends."""


class Fold:
    """The state of one substream under user logic; the same for tables and for streams."""

    def __init__(self, make: Callable[[], Aggregate]):
        self.make, self.logic = make, None
        self.first = self.last = None  # offsets of the rows that are held
        self.held = 0

    def _emit(self) -> list[tuple]:
        """(offset of the last row, result...), unless the logic refuses."""
        said = self.logic.result()
        if said is None:
            return []
        row = said.row if isinstance(said, Exit) else said
        if isinstance(said, Exit):
            self.close()
        self.first, self.held = None, 0
        return [(self.last, *row)]

    def step(self, offset: int, row: NamedTuple) -> list[tuple]:
        self.logic = self.logic or self.make()
        said, out = self.logic.add(offset, row), []
        if said == "reject" and self.held:
            out = self._emit()
            self.logic = self.logic or self.make()
            said = self.logic.add(offset, row)
        self.first = offset if self.first is None else self.first
        self.last, self.held = offset, self.held + 1
        return out + (self._emit() if said in ("flush", "reject") else [])

    def flush(self) -> list[tuple]:
        """What is held at the end of the input, or when the clock says so."""
        return self._emit() if self.held else []

    def close(self) -> None:
        if self.logic is not None:
            self.logic.close()
        self.logic = None


def aggregate_by(make: Callable[[], Aggregate], schema: str) -> Stage:
    """Runs user logic over each substream; the output columns are topic, partition, route, offset and ``schema``."""
    full = f"topic string, partition int, route array<string>, offset long, {schema}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, None

        def end() -> list:
            rows = [(*key[:2], list(key[2]), *r) for r in fold.flush()]
            fold.close()
            return rows

        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                k = (row.topic, row.partition, tuple(row.route))
                if k != key:
                    if fold is not None:
                        out += end()
                    key, fold = k, Fold(make)
                out += [(*k[:2], list(k[2]), *r) for r in fold.step(row.offset, row)]
            yield pd.DataFrame(out, columns=names)
        if fold is not None:
            yield pd.DataFrame(end(), columns=names)

    names = StructType.fromDDL(full).names

    def stage(df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        return df.repartition(*STREAM).sortWithinPartitions(*STREAM, *ORDER).mapInPandas(run, full)

    return stage
