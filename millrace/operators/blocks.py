"""Running values of substreams in two levels: inside blocks, and over the blocks.

A substream of any size is ordered by many tasks: each orders the rows of one block of it, one
small row for each block carries what the blocks before it add up to. Rows are joined with their
block by plain keys, so they stay where the window left them.

Defined cases: nulls in the keys are values like any other; rows without an offset are a block of
their own, before all others; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets of one block.
BLOCK = 65_536


def _keyed(df: DataFrame, keys: Sequence[str], at: Column, block: int) -> DataFrame:
    return df.withColumns({"_blk_key": F.to_json(F.struct(*keys)), "_blk_no": F.coalesce(F.floor(at / F.lit(block)), F.lit(-(2**62)))})


def _with(rows: DataFrame, blocks: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows with what their block has from the blocks before it."""
    there = blocks.withColumnsRenamed({"_blk_key": "_blk_key2", "_blk_no": "_blk_no2"})
    both = rows.join(there, (F.col("_blk_key") == F.col("_blk_key2")) & (F.col("_blk_no") == F.col("_blk_no2")))
    return both.withColumns(columns).drop("_blk_key", "_blk_no", "_blk_key2", "_blk_no2", "_blk_near", "_blk_far", "_blk_value")


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, how: str = "sum", at: str = "offset",
    backward: bool = False, inclusive: bool = False, block: int = BLOCK,
) -> DataFrame:
    """Adds ``name``: the sum, least or greatest ``value`` of the rows before each row (and of itself, if ``inclusive``).

    ``at`` is a number that the blocks are cut by and ``order`` begins with; ``backward`` goes from the last row to the first.
    """
    fold, turn = {"sum": F.sum, "min": F.min, "max": F.max}[how], F.desc if backward else F.asc
    inside = Window.partitionBy("_blk_key", "_blk_no").orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    over = Window.partitionBy("_blk_key").orderBy(turn("_blk_no")).rowsBetween(Window.unboundedPreceding, -1)
    d = _keyed(df, keys, F.col(at), block).withColumn("_blk_value", value)
    blocks = d.groupBy("_blk_key", "_blk_no").agg(fold("_blk_value").alias("_blk_value")).select("_blk_key", "_blk_no", fold("_blk_value").over(over).alias("_blk_far"))
    near, far = F.col("_blk_near"), F.col("_blk_far")
    whole = {"sum": F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)), "min": F.least(near, far), "max": F.greatest(near, far)}[how]
    return _with(d.withColumn("_blk_near", fold("_blk_value").over(inside)), blocks, {name: whole})


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], at: str = "offset", block: int = BLOCK) -> DataFrame:
    """Adds the value of the row before each row: ``columns`` maps names to the columns they are taken from."""
    d = _keyed(df, keys, F.col(at), block)
    w = Window.partitionBy("_blk_key", "_blk_no").orderBy(*order)
    own = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    last = d.groupBy("_blk_key", "_blk_no").agg(F.max_by(own, F.struct(*order)).alias("_blk_own"))
    last = last.select("_blk_key", "_blk_no", F.lag("_blk_own").over(Window.partitionBy("_blk_key").orderBy("_blk_no")).alias("_blk_far"))
    taken = F.coalesce("_blk_near", "_blk_far")
    return _with(d.withColumn("_blk_near", F.lag(own).over(w)), last, {n: taken[n] for n in columns})
