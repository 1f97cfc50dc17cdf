"""Substreams: split by key, merge, and logic that depends on the substream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.stateless import Stage


def demux(key: Column) -> Stage:
    """Pushes a key on the route; stateful stages after it keep one state for each route."""
    return lambda df: df.withColumn("route", F.array_prepend("route", key.cast("string")))


def join_streams() -> Stage:
    """Pops the route: substreams merge again (order by offset and ord)."""
    return lambda df: df.withColumn("route", F.when(F.size("route") > 1, F.slice("route", 2, F.size("route") - 1)).otherwise(F.array().cast("array<string>")))


def route_head() -> Column:
    return F.try_element_at("route", F.lit(1))


def route_dependent(choices: dict[str, dict[str, Column]], default: dict[str, Column] | None = None) -> Stage:
    """Columns chosen by the head of the route, as one projection; null where no choice fits."""

    def stage(df: DataFrame) -> DataFrame:
        names = sorted({n for c in [*choices.values(), default or {}] for n in c})
        out = {}
        for n in names:
            value = (default or {}).get(n, F.col(n) if n in df.columns else F.lit(None))
            for head, columns in choices.items():
                if n in columns:
                    value = F.when(route_head() == head, columns[n]).otherwise(value)
            out[n] = value
        return df.withColumns(out)

    return stage


def route_stages(choices: dict[str, Stage], default: Stage | None = None) -> Stage:
    """A stage of its own for each head of the route; rows of other heads go through ``default``, or on as they are.

    All stages must give the same columns. Each branch is one filter on the input, which is read once
    a branch; use ``route_dependent`` where the choice is a matter of columns only.
    """

    def stage(df: DataFrame) -> DataFrame:
        known = F.coalesce(F.try_element_at("route", F.lit(1)), F.lit(None).cast("string"))
        out = df.where(known.isNull() | ~known.isin(*choices)).transform(default or (lambda d: d))
        for head, then in choices.items():
            out = out.unionByName(df.where(known == head).transform(then))
        return out

    return stage
