"""Which offset is safe to commit: never one beyond data that is still held in an open chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import blocks


def safe_offsets(chunks: DataFrame) -> DataFrame:
    """Adds ``safe`` to chunks (topic, partition, route, chunk, first_offset, offset, is_open).

    For a closed chunk it is the least of its own last offset and, over chunks of the partition
    that were begun but not ended by then, the offset before their first. That interval
    condition is answered without a self-join: going back from the last chunk of the partition,
    a running least of first offsets over chunks that end later, block by block.
    """
    end = F.when(F.col("is_open"), F.lit(2**62)).otherwise(F.col("offset"))
    d = chunks.withColumn("_end", end.cast("long"))
    d = blocks.running(d, ["topic", "partition"], ["_end", "offset"], F.col("first_offset"), "_held", "min", "_end", backward=True)
    safe = F.when(F.col("is_open"), F.col("offset")).otherwise(
        F.least(F.col("offset"), F.when(F.col("_held") <= F.col("offset"), F.col("_held") - 1))
    )
    return d.withColumn("safe", safe).drop("_end", "_held")


def committed(chunks: DataFrame) -> DataFrame:
    """Highest safe offset of each partition after its closed chunks; it never goes back."""
    return safe_offsets(chunks).where(~F.col("is_open")).groupBy("topic", "partition").agg(F.max("safe").alias("committed"))


def forwarded(hidden: DataFrame, chunks: DataFrame) -> DataFrame:
    """The hidden records (topic, partition, offset) that go on to advance the commit: those that come while no
    substream of their partition holds anything. The others are dropped.

    Chunks begun before less chunks ended before is the number held; it is added up block by block.
    """
    keys = ["topic", "partition"]
    begun = chunks.select(*keys, F.col("first_offset").alias("offset"), F.lit(1).alias("_d"))
    ended = chunks.where(~F.col("is_open")).select(*keys, "offset", F.lit(-1).alias("_d"))
    seen = hidden.select(*keys, "offset", F.lit(0).alias("_d"))
    held = blocks.running(begun.unionByName(ended).unionByName(seen), keys, ["offset", "_d"], F.col("_d"), "_held")
    return held.where("_d = 0 AND _held = 0").select(*keys, "offset")
