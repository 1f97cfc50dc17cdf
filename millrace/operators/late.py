"""Late and out-of-order events.

Per-period aggregates by event time, corrected while late records arrive, up to a cut-off.
The state of a period is the multiset of its values (rows ``source..., period, value, cnt``).
A late record only changes counts; medians, distinct counts and extremes are derived again
from cumulative counts, so they stay exact after any correction.

Whether a record is past the cut-off depends on arrival order alone: the largest event time
among records with a lower offset of the same partition. That prefix maximum is taken in two
levels, over blocks of offsets and inside each block, so no partition is ordered in one task.

Periods of up to ``CROWD`` records are ranked where their records meet, each in one task: the
state needs one exchange. Where the source has a larger period, its values are spread over range
partitions instead (module ``cumulative``).

Defined cases: records with a null event time are never late and belong to no period; null
values are counted as records (they stay in the state as a value of their own) but carry no
rank; a period with null values only has a count and nothing else; repeated records (same
partition and offset) count once; an empty table gives an empty result; other columns are left
alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.common import cut
from millrace.operators.cumulative import cumulate, merge_counts

#: Offsets in one block; bounds the rows of one window group.
BLOCK = 65_536
#: Records of a period that are ranked in one task.
CROWD = 2_000_000


def mark_late(df: DataFrame, ts: str = "ts", cutoff_minutes: int = 30, block: int = BLOCK, behind: str | None = None) -> DataFrame:
    """One row for each (partition, offset), with the added column ``is_late``.

    The column ``behind``, if named, marks the records out of time order, past the cut-off or not.
    """
    # plain keys, never null, so that the join finds the rows where the windows left them
    lane = F.coalesce(F.col("partition"), F.lit(-(2**31)))
    src = df.withColumns({"_lane": lane, "_block": F.coalesce(F.floor(F.col("offset") / F.lit(block)), F.lit(-(2**62)))})
    inside = Window.partitionBy("_lane", "_block").orderBy("offset")
    rows = (
        src.withColumn("_again", F.col("offset").eqNullSafe(F.lag("offset").over(inside)) & F.col("offset").isNotNull())
        .withColumn("_near", F.max(ts).over(inside.rangeBetween(Window.unboundedPreceding, -1)))
        .where(~F.col("_again"))
    )
    tops = src.groupBy("_lane", "_block").agg(F.max(ts).alias("_top"))
    earlier = Window.partitionBy("_lane").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("_lane").alias("_p"), F.col("_block").alias("_b"), F.max("_top").over(earlier).alias("_far"))
    joined = rows.join(tops, (rows["_lane"] == tops["_p"]) & (rows["_block"] == tops["_b"]))
    high = F.greatest("_near", "_far")
    late = F.coalesce(F.col(ts) < high - F.expr(f"INTERVAL {int(cutoff_minutes)} MINUTES"), F.lit(False))
    marks = {"is_late": late} | ({behind: F.coalesce(F.col(ts) < high, F.lit(False))} if behind else {})
    return joined.withColumns(marks).drop("_again", "_near", "_far", "_lane", "_block", "_p", "_b")


def _period(ts: str) -> Column:
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


def crowded_periods(df: DataFrame, sources: Sequence[str], ts: str = "ts", crowd: int = CROWD) -> DataFrame | None:
    """The periods with more than ``crowd`` stored records, or None if there are none.

    Only sources with so many records in all are counted by period, so for most data it is one small aggregate.
    """
    rows = df.where(F.col(ts).isNotNull()).select(*sources, _period(ts).alias("period"))
    large = cut(rows.groupBy(*sources).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).drop("_n"))
    if large.isEmpty():
        return None
    there = large.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(sources)])
    rows = rows.join(there, _same(sources), "left_semi")
    crowded = cut(rows.groupBy(*sources, "period").agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).drop("_n"))
    return None if crowded.isEmpty() else crowded


def _same(names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for i, c in enumerate(names):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    return cond


def period_state(accepted: DataFrame, sources: Sequence[str], value: str, ts: str = "ts", crowded: DataFrame | None = None) -> DataFrame:
    """Multiset state of each source and hour of event time; records without a value count under a null."""
    groups = [*sources, "period"]
    rows = accepted.where(F.col(ts).isNotNull()).select(*sources, _period(ts).alias("period"), value)
    # without crowded periods all later steps find the rows of a period in one place
    rows = rows.repartition(*groups) if crowded is None else rows
    return rows.groupBy(*groups, value).agg(F.count("*").alias("cnt"))


def correct(state: DataFrame, late_state: DataFrame, sources: Sequence[str], value: str) -> DataFrame:
    """State after late records (positive counts) or retractions (negative counts)."""
    return merge_counts(state, late_state, [*sources, "period"], value)


def period_totals(state: DataFrame, sources: Sequence[str], value: str, crowded: DataFrame | None = None) -> DataFrame:
    """Exact aggregates of each source and period: n_records, n_distinct, total, min_value,
    max_value and the lower median, all derived from the multiset."""
    groups = [*sources, "period"]
    # nulls have a count but no rank
    ranked = state.select(*groups, value, F.when(F.col(value).isNotNull(), F.col("cnt")).otherwise(0).alias("cnt"), F.when(F.col(value).isNull(), F.col("cnt")).otherwise(0).alias("_nulls"))
    few, many = ranked, None
    if crowded is not None:
        there = crowded.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(groups)])
        few, many = (ranked.join(there, _same(groups), how) for how in ("left_anti", "left_semi"))
    w = Window.partitionBy(*groups)
    upto = F.sum("cnt").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    cum = few.withColumns({"prior": upto - F.col("cnt"), "total": F.sum("cnt").over(w)})
    if many is not None:
        cum = cum.unionByName(cumulate(many, groups, value, ["_nulls"]))
    middle = F.floor((F.col("total") + 1) / 2)
    hit = (F.col("prior") < middle) & (middle <= F.col("prior") + F.col("cnt"))
    return cum.groupBy(*groups).agg(
        F.sum(F.col("cnt") + F.col("_nulls")).alias("n_records"),
        F.count(value).alias("n_distinct"),
        F.sum(F.col(value) * F.col("cnt")).alias("total"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.max(F.when(hit, F.col(value))).alias("median"),
    )
