"""Queries of dashboards over monitoring records, with the viewer's node and range of time as parameters.

Without a node, results are given for every node; without a range, over all of the table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.records import rounded_bucket

#: A chart has a hundred buckets.
BUCKETS = 100


def selected(df: DataFrame, node: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """Rows of the node and range, both ends included; filters reach the scan."""
    df = df.where(F.col("ts").isNotNull())
    for cond in (F.col("node") == node if node else None, F.col("ts") >= F.lit(start) if start else None, F.col("ts") <= F.lit(end) if end else None):
        df = df if cond is None else df.where(cond)
    return df


def bucket_width(df: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None) -> int:
    """A hundredth of the range in whole seconds; an open end of the range is taken from the table."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = [int(x.replace(tzinfo=dt.UTC).timestamp()) if x else None for x in (start, end)]
    if None in ends:
        low, high = df.agg(F.floor(F.min(us) / 1e6), F.ceil(F.max(us) / 1e6)).first()
        if low is None:
            return 1
        ends = [low if ends[0] is None else ends[0], high if ends[1] is None else ends[1]]
    return max((ends[1] - ends[0]) // BUCKETS, 1)


def averages(
    df: DataFrame, key: str, value: str, where: Column, log: bool = False,
    node: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None,
) -> DataFrame:
    """``(node, key, bucket, mean)``: the mean (or its decimal logarithm) of each node, key and time bucket."""
    width = bucket_width(df, start, end)
    mean = F.sum(value).cast("double") / F.count(value)
    out = selected(df, node, start, end).where(where).groupBy("node", key, rounded_bucket(F.col("ts"), width).alias("bucket")).agg(mean.alias("mean"))
    return out.select("node", key, "bucket", F.round(F.when(F.col("mean") > 0, F.log10("mean")), 9).alias("log_mean")) if log else out


def latest_status(role: DataFrame, node: str | None = None, start: dt.datetime | None = None) -> DataFrame:
    """``(node, ts, data)``: what each node said last, after ``start``."""
    rows = selected(role, node) if start is None else selected(role, node).where(F.col("ts") > F.lit(start))
    return rows.groupBy("node").agg(F.max("ts").alias("ts"), F.max_by("data", F.struct("ts", "offset")).alias("data"))


def _last_report(role: DataFrame, node: str | None, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    rows = selected(role, node)
    rows = rows if start is None else rows.where(F.col("ts") > F.lit(start))
    rows = rows if end is None else rows.where(F.col("ts") < F.lit(end))
    return rows.groupBy("node").agg(F.max("ts").alias("_r"))


PROCESS = ["pid", "registered_name", "reductions", "dreductions", "message_queue_len", "memory", "dmemory", "stack_size", "heap_size", "total_heap_size", "initial_call", "current_function"]


def snapshot(
    prc: DataFrame, role: DataFrame, node: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None, nearest: bool = False
) -> DataFrame:
    """All processes of each node at the time of its last report inside the range; with ``nearest``, at the last
    snapshot that is not after that report."""
    at = _last_report(role, node, start, end)
    if not nearest:
        return prc.join(at, (prc["node"] == at["node"]) & (prc["ts"] == at["_r"])).select(prc["node"], "ts", *PROCESS)
    last = prc.join(at, "node").where("ts <= _r").groupBy("node").agg(F.max("ts").alias("ts"))
    return prc.join(last, ["node", "ts"], "left_semi").select("node", "ts", *PROCESS)


def history(
    prc: DataFrame, columns: list[str], pid: str | None = None, name: str | None = None,
    node: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None, not_in: str | None = None,
) -> DataFrame:
    """Readings of one process (by pid or registered name; of all if neither is given) in order of time.

    ``not_in`` leaves out readings whose current function begins with it, and those without one.
    """
    rows = selected(prc, node, start, end)
    if pid or name:
        who = [F.col(c) == v for c, v in (("pid", pid), ("registered_name", name)) if v]
        rows = rows.where(who[0] | who[1] if len(who) == 2 else who[0])
    if not_in:
        rows = rows.where(~F.col("current_function").startswith(not_in))
    return rows.select("node", "ts", *columns).orderBy("node", "ts")
