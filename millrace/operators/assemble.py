"""Reassembly of objects sent in numbered slices, with repeats, restarts and gaps.

Slices of one key are taken in order of offset. A slice with ``num = cnt`` ends a transfer, so
transfers are islands between such slices. A transfer that begins with slice 1 is fresh: a
slice not above the highest number so far is a repeat and ignored, a slice that skips numbers
marks the transfer as corrupted but is taken. A transfer that begins later is not complete: at
its end it yields one row marked as retransmission, without contents. A transfer that never
ends yields nothing. Transfers are numbered in blocks of offsets, so a key with most of the slices
is numbered by many tasks, and only the slices of one transfer are ordered together.

Defined cases: a slice without a number or count ends nothing; a null key is a key like any other;
an empty table gives no objects. ``assemble`` puts an object into one row, which a row's size
bounds; ``sinks.files.write_slices`` writes objects of any size slice by slice.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import blocks
from millrace.operators.chunking import Aggregate, Exit, aggregate_by
from millrace.operators.stateless import Stage


def header(name: str, headers: str = "headers") -> Column:
    """Text of the first header of that name, or null."""
    return F.try_element_at(F.filter(headers, lambda h: h["key"] == name), F.lit(1))["value"].cast("string")


def transfers(df: DataFrame, num: Column, cnt: Column) -> DataFrame:
    """Adds ``transfer`` (number inside the key), ``is_fresh``, ``is_taken`` and ``skips``."""
    d = df.withColumns({"_num": num.cast("int"), "_cnt": cnt.cast("int")})
    ends = F.coalesce((F.col("_num") == F.col("_cnt")).cast("int"), F.lit(0))
    d = blocks.running(d, ["topic", "partition", "key"], ["offset", "ord"], ends, "transfer")
    inside = Window.partitionBy("topic", "partition", "key", "transfer").orderBy("offset", "ord")
    top = F.coalesce(F.max("_num").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumns({"_top": top, "is_fresh": F.first("_num").over(inside) == 1})
    return d.withColumns(
        {"is_taken": F.col("is_fresh") & (F.col("_num") > F.col("_top")), "skips": F.col("is_fresh") & (F.col("_num") > F.col("_top") + 1)}
    )


def assemble(df: DataFrame, num: Column, cnt: Column, content: Column, deleted: Column | None = None) -> DataFrame:
    """One row for each ended transfer: topic, partition, key, offset, retransmission, corrupted,
    deleted, n_slices and ``content`` (the slices one after another; null for a retransmission)."""
    flag = F.coalesce(deleted, F.lit("0")) == "1" if deleted is not None else F.lit(False)
    d = transfers(df.withColumns({"_content": content, "_del": flag}), num, cnt)
    taken = F.when(F.col("is_taken"), F.struct("offset", "ord", F.coalesce("_content", F.lit(b"")).alias("c")))
    slices = F.array_sort(F.collect_list(taken))
    joined = F.unhex(F.array_join(F.transform(slices, lambda x: F.hex(x["c"])), ""))
    g = d.groupBy("topic", "partition", "key", "transfer").agg(
        F.max("offset").alias("offset"),
        F.max("is_fresh").alias("_fresh"),
        F.max(F.col("_num") == F.col("_cnt")).alias("_ended"),
        F.max("skips").alias("corrupted"),
        F.max(F.col("_del") & (F.col("_num") == 1)).alias("deleted"),
        F.count(taken).cast("int").alias("n_slices"),
        joined.alias("_joined"),
    )
    return g.where("_ended").select(
        "topic", "partition", "key", "offset", (~F.col("_fresh")).alias("retransmission"), "corrupted", "deleted", "n_slices",
        F.when(F.col("_fresh"), F.col("_joined")).alias("content"),
    )


class Assembler(Aggregate):
    """User logic for sliced objects, slice by slice: give ``number``, ``count``, ``take`` and ``finish``.

    Repeats are left out, slices after a gap are taken and ``corrupted`` is set, a transfer that begins
    in the middle is waited out and ends as a retransmission; a transfer that has not ended is refused.
    """

    def __init__(self) -> None:
        self.top, self.fresh, self.corrupted, self.ended = 0, None, False, False

    def number(self, row: NamedTuple) -> int:
        raise NotImplementedError

    def count(self, row: NamedTuple) -> int:
        raise NotImplementedError

    def take(self, offset: int, row: NamedTuple) -> None:
        """Takes a slice of a fresh transfer, in order."""
        raise NotImplementedError

    def finish(self) -> tuple:
        """The output row of a fresh transfer."""
        raise NotImplementedError

    def lost(self) -> tuple:
        """The output row of a retransmission."""
        raise NotImplementedError

    def add(self, offset: int, row: NamedTuple) -> str:
        num = self.number(row)
        self.fresh = num == 1 if self.fresh is None else self.fresh
        if self.fresh and num > self.top:
            self.corrupted |= num > self.top + 1
            self.top = num
            self.take(offset, row)
        self.ended = num == self.count(row)
        return "flush" if self.ended else "keep"

    def result(self) -> Exit | None:
        return Exit(self.finish() if self.fresh else self.lost()) if self.ended else None


def assemble_by(make: Callable[[], Assembler], schema: str) -> Stage:
    """Runs an assembler over each substream (split it by key first); works in streams through ``aggregate_stream`` as well."""
    return aggregate_by(make, schema)
