"""Order statistics from value counts, without gathering a group in one task.

The state of a group is a multiset: rows ``(group..., value, cnt)``. States of different
partitions, days or batches are combined by adding counts. Ranks come from cumulative
frequencies: the state is range-sorted by (group, value), each range partition adds up its
own counts, the totals of the partitions before it are added as offsets, and the first value
whose cumulative count reaches a target rank is the answer. A group of any size is spread
over as many range partitions as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.common import cut


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Multiset state ``groups + (value, cnt)``; null values carry no rank and are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("cnt"))


def merge_counts(state: DataFrame, delta: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Adds a state or a correction (counts may be negative) to a state; zero counts disappear."""
    cols = [*groups, value, "cnt"]
    both = state.select(*cols).unionByName(delta.select(*cols))
    return both.groupBy(*groups, value).agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")


def same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    """Null-safe equality on all of ``cols``."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def cumulate(state: DataFrame, groups: Sequence[str], value: str, extra: Sequence[str] = ()) -> DataFrame:
    """``groups + (value, cnt, extra..., prior, total)``: counts below each value, and of the whole group.

    The range-sorted state is written to the shared folder once, so the partition numbers used
    for the offsets and for the running sums are the same ones, also after a lost executor.
    """
    groups = list(groups)
    ranged = cut(
        state.select(*groups, value, "cnt", *extra)
        .repartitionByRange(*[F.col(c) for c in [*groups, value]])
        .withColumn("_pid", F.spark_partition_id())
    )
    inside = Window.partitionBy("_pid", *groups).orderBy(value)
    run = ranged.withColumn("_run", F.sum("cnt").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ranged.groupBy("_pid", *groups)
        .agg(F.sum("cnt").alias("_sum"))
        .withColumn("_off", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .withColumn("total", F.sum("_sum").over(whole))
        .select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], "_off", "total")
    )
    cond = F.col("_pid") == F.col("_p")
    for i, c in enumerate(groups):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return run.join(parts, cond).select(
        *groups, value, "cnt", *extra, (F.col("_off") + F.col("_run") - F.col("cnt")).alias("prior"), "total"
    )


def pick_ranks(cumulated: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """Rows of ``cumulated`` at which a target rank (1-based, may use ``total``) is reached,
    one row for each name in ``ranks``, in the column ``rank_name``."""
    hits = F.array_compact(
        F.array(*[F.when((F.col("prior") < r) & (r <= F.col("prior") + F.col("cnt")), F.lit(k)) for k, r in ranks.items()])
    )
    return cumulated.withColumn("rank_name", F.explode(hits))
