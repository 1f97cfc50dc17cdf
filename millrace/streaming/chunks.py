"""Streaming counterparts of the stateful stages: open chunks and transfers live in a state store.

Inside a batch the rows of a substream are sorted; across batches the source must bring offsets
in growing order, as a message queue does. What is open when the query stops stays in the
state and is continued by the next run from the same checkpoint. A substream is its whole route:
routes with the same text but other parts, or with nulls, have states of their own.

Defined cases: a run with nothing new changes nothing and returns the table as it is; a table
nothing was ever written to is empty.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from millrace.common import Files, scratch, ship
from millrace.operators.chunking import Aggregate, Fold
from millrace.sinks.table import latest_by_key

KEYS = "topic string, partition int, route array<string>"


def _by_route(df: DataFrame, *columns: object) -> DataFrame:
    """Grouped by topic, partition and the route as JSON text, which says all of it."""
    ship(df.sparkSession)
    return df.select("topic", "partition", F.to_json("route").alias("_route"), *columns)


def chunk_stream(df: DataFrame, length: int, value: str, flush_ms: int | None = None) -> DataFrame:
    """Closed chunks of ``length`` rows: topic, partition, route, chunk, first_offset, offset, n, total (of ``value``).

    ``flush_ms``: an open chunk is emitted when its substream has brought nothing for so long by
    the clock. Such a query keeps running batches, also where nothing arrives; end it with ``stop``.
    The state of a substream is four numbers, however long its chunks are.
    """
    columns = ["topic", "partition", "route", "chunk", "first_offset", "offset", "n", "total"]

    def frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], json.loads(key[2]), *r) for r in rows], columns=columns)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, n, first, last, total = pickle.loads(bytes(state.get[0])) if state.exists else (0, 0, 0, 0, 0.0)
        if state.hasTimedOut:
            if n:
                yield frame(key, [(number, first, last, n, total)])
                state.update((pickle.dumps((number + 1, 0, 0, 0, 0.0)),))
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values("offset", kind="stable")
        offset, held = rows["offset"].to_numpy(), rows["_value"].to_numpy()
        starts = np.append(0, np.arange(length - n, len(rows), length))  # where chunks begin among the new rows
        ends = np.append(starts[1:], len(rows))
        sums = np.add.reduceat(held, np.minimum(starts, len(rows) - 1))
        out = []
        for a, z, s in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
            first, total = (first, total + s) if n else (int(offset[a]), s)
            n, last = n + z - a, int(offset[z - 1])
            if n == length:
                out.append((number, first, last, n, total))
                number, n, total = number + 1, 0, 0.0
        state.update((pickle.dumps((number, n, first, last, total)),))
        if flush_ms and n:
            state.setTimeoutDuration(flush_ms)
        yield frame(key, out)

    rows = _by_route(df, "offset", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_value"))
    return rows.groupBy("topic", "partition", "_route").applyInPandasWithState(
        step, f"{KEYS}, chunk long, first_offset long, offset long, n long, total double",
        "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout if flush_ms else GroupStateTimeout.NoTimeout,
    )


def aggregate_stream(df: DataFrame, make: Callable[[], Aggregate], schema: str, flush_ms: int | None = None) -> DataFrame:
    """User logic over each substream of a stream, with its state kept between batches.

    Output: topic, partition, route, offset, ``safe`` (the offset before the first row still held in
    the substream, else null) and ``schema``. After an ``Exit`` the state of the substream is removed.
    ``flush_ms`` as in ``chunk_stream``; logic that refuses is asked again after as long.
    """
    columns = StructType.fromDDL(schema).names

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Fold(make)
        if state.exists:
            fold.logic, fold.first, fold.last, fold.held = pickle.loads(bytes(state.get[0]))
        out: list[tuple] = []

        def told(rows: list[tuple]) -> None:
            out.extend((r[0], fold.first - 1 if fold.held else None, *r[1:]) for r in rows)

        if state.hasTimedOut:
            told(fold.flush())
        else:
            rows = pd.concat(list(frames), ignore_index=True).sort_values(["offset", "ord"], kind="stable", key=lambda c: c.map(tuple) if c.name == "ord" else c)
            for row in rows.itertuples(index=False):
                told(fold.step(row.offset, row))
        if fold.logic is None and not fold.held:
            if state.exists:
                state.remove()
        else:
            state.update((cloudpickle.dumps((fold.logic, fold.first, fold.last, fold.held)),))
            if flush_ms and fold.held:
                state.setTimeoutDuration(flush_ms)
        done = pd.DataFrame([(key[0], key[1], json.loads(key[2]), *r) for r in out], columns=["topic", "partition", "route", "offset", "safe", *columns])
        yield done.astype({"safe": "Int64"})

    rest = [c for c in df.columns if c not in ("topic", "partition", "route")]
    return _by_route(df, *rest).groupBy("topic", "partition", "_route").applyInPandasWithState(
        step, f"{KEYS}, offset long, safe long, {schema}", "held binary", "append",
        GroupStateTimeout.ProcessingTimeTimeout if flush_ms else GroupStateTimeout.NoTimeout,
    )


def assemble_stream(df: DataFrame) -> DataFrame:
    """Ended transfers of sliced objects: topic, partition, key, offset, retransmission, corrupted, n_slices, n_bytes.

    ``df`` has topic, partition, key, offset, num, cnt, value. The state of a key is its open transfer;
    only the sizes of the slices go to the workers.
    """
    ship(df.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh, top, skips, n, size = pickle.loads(bytes(state.get[0])) if state.exists else (None, 0, False, 0, 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values("offset", kind="stable")
        out = []
        for offset, num, cnt, length in zip(rows["offset"].tolist(), rows["num"].tolist(), rows["cnt"].tolist(), rows["_length"].tolist(), strict=True):
            if fresh is None:
                fresh = num == 1
            if fresh and num > top:
                skips, n, size, top = skips or num > top + 1, n + 1, size + length, num
            if num == cnt:
                out.append((key[0], key[1], key[2], offset, not fresh, skips, n, size if fresh else None))
                fresh, top, skips, n, size = None, 0, False, 0, 0
        state.update((pickle.dumps((fresh, top, skips, n, size)),))
        frame = pd.DataFrame(out, columns=["topic", "partition", "key", "offset", "retransmission", "corrupted", "n_slices", "n_bytes"])
        yield frame.astype({"n_bytes": "Int64"})

    rows = df.select("topic", "partition", "key", "offset", "num", "cnt", F.coalesce(F.octet_length("value"), F.lit(0)).alias("_length"))
    return rows.groupBy("topic", "partition", "key").applyInPandasWithState(
        step, "topic string, partition int, key string, offset long, retransmission boolean, corrupted boolean, n_slices int, n_bytes long",
        "held binary", "append", GroupStateTimeout.NoTimeout,
    )


def run_to_end(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over what there is, batch by batch, from its checkpoint."""
    df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_table(out: DataFrame, root: str) -> DataFrame:
    """Runs the stream to its present end; each batch owns a folder, so a batch run again repeats nothing."""
    spark = out.sparkSession
    run_to_end(out, lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint")
    if not Files(spark, root).exists("out"):
        return spark.createDataFrame([], out.schema)
    return spark.read.schema(out.schema).option("basePath", f"{root}/out").parquet(f"{root}/out").select(*out.columns)


#: Buckets of an upsert table; a batch rewrites those of its keys.
BUCKETS = 64


def upsert_table(spark: SparkSession, schema: StructType, root: str) -> DataFrame:
    """The table as the last finished batch left it."""
    files = Files(spark, root)
    versions = [int(n) for n in files.names("versions") if n.isdigit()]
    where = files.read(f"versions/{max(versions)}")["buckets"] if versions else {}
    paths = [f"{root}/table/{v}/bucket={b}" for b, v in where.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_stream(df: DataFrame, keys: list[str], root: str, buckets: int = BUCKETS) -> DataFrame:
    """Keeps the last version of each key, by offset.

    The table lies in buckets of its keys. Batch n writes anew the buckets it has keys of, and then a
    small file that says where each bucket is; folders that the batch before last no longer needed
    are deleted. A batch that runs again starts from the version before it.
    """
    spark, schema = df.sparkSession, df.schema
    files = Files(spark, root)

    def merge(batch: DataFrame, number: int) -> None:
        known = [int(n) for n in files.names("versions") if n.isdigit() and int(n) < number]
        before = files.read(f"versions/{max(known)}") if known else {"buckets": {}, "old": []}
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        batch = latest_by_key(batch, keys).persist()
        try:
            touched = sorted(str(r[0]) for r in batch.select(bucket).distinct().collect())
            held = [f"{root}/table/{before['buckets'][b]}/bucket={b}" for b in touched if b in before["buckets"]]
            rows = batch.select(*schema.names)
            rows = rows.unionByName(spark.read.schema(schema).parquet(*held)) if held else rows
            merged = latest_by_key(rows, keys).select(*schema.names).withColumn("bucket", bucket)
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/table/{number}")
        finally:
            batch.unpersist()
        old = [f"table/{before['buckets'][b]}/bucket={b}" for b in touched if b in before["buckets"]]
        files.write(f"versions/{number}", {"buckets": before["buckets"] | {b: number for b in touched}, "old": old})
        for name in before["old"]:
            files.drop(name)
        for n in known[:-1]:
            files.drop(f"versions/{n}")

    run_to_end(df, merge, f"{root}/checkpoint")
    return upsert_table(spark, schema, root)


def fresh_root(spark: SparkSession, name: str) -> str:
    return scratch(spark, name)
