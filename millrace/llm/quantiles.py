"""Percentiles of very large numeric columns, per group, from combinable states.

Values are put on a grid of ``digits`` significant decimal digits; the state of a group and
day is its value counts on that grid: at most ``9 * 10**(digits-1)`` values per power of ten
and sign, however many rows there are. States of days or partitions combine by adding counts.
Percentiles are nearest-rank over cumulative frequencies of the range-sorted state (module
``cumulative``); the reported value is the middle of its grid cell, so its error is at most
``0.5 * 10**(1-digits)`` of the value (0.05 % for 4 digits), and zero below ``10**digits``.

Defined cases: null values carry no rank, a group with no value has no row; a null group key
is a group of its own; repeated records (same identifier) count once where ``ident`` is given,
rows with a null in the identifier each on their own;
ties share a cell; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.cumulative import cumulate, merge_counts, pick_ranks

DIGITS = 4


def with_cell(df: DataFrame, raw: str, name: str = "value", digits: int = DIGITS) -> DataFrame:
    """Adds the middle of the grid cell of an integer column, as a long; monotone in the value, null for null.

    In steps of one projection each, so that nothing is worked out twice and the generated code stays small.
    """
    d = df.withColumn("_size", F.abs(F.greatest(F.coalesce(F.col(raw).cast("long"), F.lit(0)), F.lit(-(2**63 - 1)))))
    step = F.when(F.col("_size") < 10**digits, F.lit(1).cast("long"))
    for p in range(digits + 1, 19):
        step = step.when(F.col("_size") < 10**p, F.lit(10 ** (p - digits)).cast("long"))
    d = d.withColumn("_step", step.otherwise(F.lit(10 ** (19 - digits)).cast("long")))
    d = d.withColumn("_low", F.col("_size") - F.col("_size") % F.col("_step"))
    # the last cell before the largest long keeps its lower edge
    half = F.when(F.col("_low") > F.lit(2**63 - 1) - F.col("_step"), F.lit(0).cast("long")).otherwise(F.shiftright("_step", 1))
    middle = F.col("_low") + half
    return d.withColumn(name, F.when(F.col(raw) < 0, -middle).when(F.col(raw) >= 0, middle)).drop("_size", "_step", "_low")


def state(
    df: DataFrame, groups: Sequence[Column], fields: Sequence[str], digits: int = DIGITS, ident: Sequence[str] | None = None
) -> DataFrame:
    """``(g0, g1, ..., field, value, cnt)``: combinable state, aggregated map-side before the shuffle.

    Rows of one group with the same ``ident`` count once; rows with a null in it are no copies of each other.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*[g.alias(k) for g, k in zip(groups, keys, strict=True)], *(ident or ()), *[F.col(f).alias(f"_{f}") for f in fields])
    if ident:
        # a row without an identifier gets a number of its own; all others share the null
        lone = F.greatest(*[F.col(c).isNull() for c in ident]) if len(ident) > 1 else F.col(ident[0]).isNull()
        rows = rows.withColumn("_lone", F.when(lone, F.monotonically_increasing_id()))
        rows = rows.groupBy(*keys, *ident, "_lone").agg(*[F.first(f"_{f}", ignorenulls=True).alias(f"_{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").cast("long").alias("raw")) for f in fields])
    long = rows.select(*keys, F.explode(pairs).alias("p"))
    return (
        with_cell(long.select(*keys, "p.field", "p.raw").where("raw IS NOT NULL"), "raw", digits=digits)
        .groupBy(*keys, "field", "value").agg(F.count("*").alias("cnt"))
    )


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """The state of two disjoint sets of rows."""
    return merge_counts(a, b, [c for c in a.columns if c not in ("value", "cnt")], "value")


def percentiles(st: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """``groups + (field, q, value, n_rows)`` by nearest rank ``ceil(q * n)``."""
    groups = [c for c in st.columns if c not in ("value", "cnt")]
    ranks = {repr(q): F.greatest(F.ceil(F.lit(float(q)) * F.col("total")), F.lit(1)) for q in quantiles}
    hits = pick_ranks(cumulate(st, groups, "value"), ranks)
    return hits.select(*groups, F.col("rank_name").cast("double").alias("q"), "value", F.col("total").alias("n_rows"))
