"""Stages without state: map, filter, fused map-filter-route, unfold.

A stage is a function ``DataFrame -> DataFrame``. Predicates and projections are Column
expressions over the payload and the envelope (the offset may be used), so that Catalyst fuses
neighbouring stages and pushes filters to the scan.
"""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.common import ship
from millrace.envelope import ENVELOPE

Stage = Callable[[DataFrame], DataFrame]


def map_rows(**columns: Column) -> Stage:
    """Replaces or adds payload columns; the envelope stays."""
    return lambda df: df.withColumns(columns)


def filter_rows(predicate: Column, strict: bool = True) -> Stage:
    """Keeps rows for which the predicate is true. ``strict``: a null predicate is an error."""
    if strict:
        predicate = F.when(predicate.isNull(), F.raise_error(F.lit("filter predicate is null"))).otherwise(predicate)
    return lambda df: df.where(predicate)


def map_filter_route(keep: Column, route: Column | None = None, **columns: Column) -> Stage:
    """One projection that keeps or drops a row, changes it and may push a route (null: none)."""

    def stage(df: DataFrame) -> DataFrame:
        out = df.where(F.coalesce(keep, F.lit(False)))
        if route is not None:
            key = route.cast("string")
            columns["route"] = F.when(key.isNull(), F.col("route")).otherwise(F.array_prepend("route", key))
        return out.withColumns(columns)

    return stage


def unfold(items: Column, name: str, safe: str | None = None) -> Stage:
    """One row for each element, in order; no row for an empty or null array.

    ``safe`` names a column with the offset that is safe to commit after a row: only the last element
    keeps it, the ones before must not commit their own record.
    """

    def stage(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in (name, "ord")]
        out = df.withColumn("_items", items).select(*rest, F.col("ord").alias("_ord"), F.size("_items").alias("_size"), F.posexplode("_items").alias("_pos", name))
        if safe:
            out = out.withColumn(safe, F.when(F.col("_pos") == F.col("_size") - 1, F.col(safe)).otherwise(F.least(F.col(safe), F.col("offset") - 1)))
        return out.withColumn("ord", F.array_append("_ord", F.col("_pos"))).drop("_ord", "_pos", "_size")

    return stage


def unfold_rows(items: Callable[[NamedTuple], Iterable[tuple]], schema: str) -> Stage:
    """Python unfold: ``items`` gives the output rows of an input row, in order, as tuples of ``schema``.

    The envelope is kept and ``ord`` grows by the place among the row's items; other columns are replaced.
    """
    names = [*ENVELOPE, *StructType.fromDDL(schema).names]
    full = f"topic string, partition int, offset long, ord array<int>, route array<string>, {schema}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r.topic, r.partition, r.offset, [*r.ord, i], r.route, *x) for r in f.itertuples(index=False) for i, x in enumerate(items(r))]
            yield pd.DataFrame(rows, columns=names)

    def stage(df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        return df.mapInPandas(run, full)

    return stage


def map_batches(init: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str,
                terminate: Callable[[object], None] | None = None, timeout: float | None = None) -> Stage:
    """Python stage with a state of its own for each task: made once, used for every batch, ended at last.

    ``timeout``: seconds after which a call of ``step`` fails with a TimeoutError.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def late(*_: object) -> None:
            raise TimeoutError(f"a call took longer than {timeout} s")

        state = init()
        try:
            for f in frames:
                if timeout:
                    signal.signal(signal.SIGALRM, late)
                    signal.setitimer(signal.ITIMER_REAL, timeout)
                try:
                    out = step(state, f)
                finally:
                    if timeout:
                        signal.setitimer(signal.ITIMER_REAL, 0)
                yield out
        finally:
            if terminate:
                terminate(state)

    def stage(df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        return df.mapInPandas(run, schema)

    return stage


def identity() -> Stage:
    return lambda df: df


def constant(**columns: object) -> Stage:
    """The payload becomes constants, whatever it was; the envelope stays."""
    return lambda df: df.select(*[c for c in ENVELOPE if c in df.columns], *[F.lit(v).alias(k) for k, v in columns.items()])
