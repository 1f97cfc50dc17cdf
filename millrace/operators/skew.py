"""A few keys holding most records: two-stage salted aggregation.

Stage one finds heavy keys from exact counts (map-side combined, and split over salts so that
no key is added up in one task). Stage two appends a salt to the rows of heavy keys only,
aggregates per (key, salt), and merges the partial results by the original key. Salts are a
hash of the row's own fields, not of a random number, so a task that runs again after a lost
executor puts every row where it was before.

Defined cases: a null or empty key is a key like any other in the aggregate and is never
reported as heavy; an empty table gives no rows; columns other than the key and the
aggregated ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Salts of a heavy key.
SALTS = 64


def _salt(by: Sequence[Column], salts: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")


def key_counts(df: DataFrame, key: Column, salt_by: Sequence[Column], salts: int = SALTS) -> DataFrame:
    """``(key, n_rows, share)`` of every key, counted in two stages."""
    partial = df.select(key.alias("key"), _salt(salt_by, salts).alias("_salt")).groupBy("key", "_salt").agg(F.count("*").alias("n"))
    counts = partial.groupBy("key").agg(F.sum("n").alias("n_rows"))
    # the sum of the counts is made from the same exchange, without another scan
    total = counts.agg(F.sum("n_rows").alias("n")).scalar()
    return counts.withColumn("share", F.col("n_rows") / total)


def heavy_keys(counts: DataFrame, share: float = 0.03) -> DataFrame:
    """Keys with at least ``share`` of all rows: at most ``1 / share`` of them. Null and empty keys are excluded."""
    return counts.where((F.col("share") >= share) & F.col("key").isNotNull() & (F.length("key") > 0))


def salted_aggregate(
    df: DataFrame,
    key: Column,
    heavy: DataFrame,
    salt_by: Sequence[Column],
    partial: dict[str, Column],
    merge: dict[str, Column],
    salts: int = SALTS,
) -> DataFrame:
    """Per-key results. ``partial`` aggregates rows of one (key, salt), ``merge`` those results.

    ``heavy`` holds at most ``1 / share`` rows, which bounds the broadcast.
    """
    hot = F.broadcast(heavy.select(F.col("key").alias("_hot")))
    rows = df.withColumn("_key", key).join(hot, F.col("_key") == F.col("_hot"), "left")
    rows = rows.withColumn("_salt", F.when(F.col("_hot").isNotNull(), _salt(salt_by, salts)).otherwise(F.lit(0)))
    one = rows.groupBy("_key", "_salt").agg(*[c.alias(k) for k, c in partial.items()])
    return one.groupBy(F.col("_key").alias("key")).agg(*[c.alias(k) for k, c in merge.items()])
