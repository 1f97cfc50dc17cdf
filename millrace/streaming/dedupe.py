"""Messages delivered more than once: exactly one copy of each comes out.

A keyed state store remembers the identifiers seen, as bitmaps over blocks of ``BLOCK``
consecutive offsets. The blocks of one topic and partition are spread over ``LANES`` keys of
the store, so that a partition with most of the records is worked on by many tasks. A block is
forgotten once the watermark of the arrival time has passed its last record by ``keep_ms``; the
store keeps only the number of the highest block forgotten. A record of a block at or below that
number, which the store does not know or has begun anew, is looked up among the identifiers
already delivered. State is checkpointed with the offsets of the query, and a batch that runs
again after a failure replaces its own output folder, so both move together.

Only identifiers and places (file and row number) go through the store and Python; what comes back
are the places of the other copies. The rows themselves are read once more and leave out those
places, by a join that adaptive execution broadcasts while the copies are few.

Defined cases: a null topic or partition is a value like any other; a record without an offset
has no identifier, is no copy of anything and is delivered; copies may differ in their other
columns, the first by arrival time (then by ``tie``, then by place) in the first batch that has
one is kept; null arrival times count as the earliest; an empty source gives an empty table; late
records are settled by lookup and never lost; columns of any name and type are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.common import Files, scratch, ship

#: Offsets of one bitmap, and keys of the store for each sequence.
BLOCK = 8192
LANES = 64
KEEP_MS = 7 * 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the store says of a record; FILE: that the batch has records of this file.
FIRST, AGAIN, LOOKUP, FILE = range(4)


def _mark(block: int, keep_ms: int):  # noqa: ANN202
    width = block // 8

    def unpack(raw: bytes) -> tuple[int, dict[int, list]]:
        n = (len(raw) - 8) // (width + 24)
        head = np.frombuffer(raw, np.int64, 1 + 3 * n)
        maps = np.frombuffer(raw, np.uint8, offset=8 + 24 * n).reshape(n, width).copy()
        return int(head[0]), {int(b): [int(t), bool(p), maps[i]] for i, (b, t, p) in enumerate(head[1:].reshape(3, n).T)}

    def pack(top: int, blocks: dict[int, list]) -> bytes:
        head = [top, *blocks, *(x[0] for x in blocks.values()), *(int(x[1]) for x in blocks.values())]
        return np.array(head, np.int64).tobytes() + b"".join(x[2].tobytes() for x in blocks.values())

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        water = state.getCurrentWatermarkMs()
        # top: the highest block that was ever forgotten; blocks above it are new
        top, blocks = unpack(bytes(state.get[0])) if state.exists else (-(2**63), {})
        for b in [b for b, x in blocks.items() if x[0] + keep_ms < water]:
            del blocks[b]
            top = max(top, b)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["_ms", "_tie", "_file", "_pos"], ignore_index=True)
        files = rows["_file"].unique()
        rows = rows[rows["_slot"] >= 0].reset_index(drop=True)
        verdict = np.full(len(rows), AGAIN, np.int8)
        ms, slots, fresh = rows["_ms"].to_numpy(np.int64), rows["_slot"].to_numpy(np.int64), ~rows.duplicated(["_block", "_slot"]).to_numpy()
        for b, at in rows.groupby("_block", sort=False).indices.items():
            held = blocks.setdefault(int(b), [0, int(b) <= top, np.zeros(width, np.uint8)])
            slot, bits = slots[at], held[2]
            bit = np.left_shift(1, slot & 7).astype(np.uint8)
            first = fresh[at] & ((bits[slot >> 3] & bit) == 0)
            verdict[at[first]] = LOOKUP if held[1] else FIRST
            np.bitwise_or.at(bits, slot >> 3, bit)
            held[0] = int(max(held[0], ms[at].max()))
        state.update((pack(top, blocks),))
        told = verdict != FIRST
        yield pd.DataFrame(
            {
                "_file": np.concatenate([files, rows["_file"].to_numpy()[told]]).astype(np.int64),
                "_pos": np.concatenate([np.full(len(files), -1), rows["_pos"].to_numpy()[told]]).astype(np.int64),
                "_verdict": np.concatenate([np.full(len(files), FILE, np.int8), verdict[told]]).astype(np.int32),
            }
        )

    return step


#: Bytes of files in one batch, which bounds what a key of the store gets at once.
BATCH_BYTES = 4 << 30


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a parquet folder or file; each file is read once."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", BATCH_BYTES)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at) and fs.getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def deliver_once(
    spark: SparkSession,
    path: str,
    ident: Sequence[str],
    at: str,
    tie: str,
    root: str,
    delay: str = "1 hour",
    keep_ms: int = KEEP_MS,
    block: int = BLOCK,
    files_per_batch: int | None = None,
    columns: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Runs a stream over the parquet files of ``path`` to its present end. Returns (one copy of
    each message, the other copies), with all columns or the named ones, which must include ``ident``.

    The last of ``ident`` is the offset; the others name its sequence. Calling it again with the
    same ``root`` continues after the last finished batch.
    """
    ship(spark)
    stream = source(spark, path, files_per_batch)
    names = list(columns or stream.columns)
    kept = T.StructType([T.StructField(f"d{i}", stream.schema[c].dataType) for i, c in enumerate(names)])
    stored = T.StructType([*kept.fields, T.StructField("again", T.BooleanType()), T.StructField("batch", T.LongType())])
    *seq, offset = ident
    arrival = F.coalesce(F.col(at).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    none, pos = F.col(offset).isNull(), F.col("_metadata.row_index")
    # records without an offset only tell of their file, from any lane
    number = F.when(none, pos).otherwise(F.expr(f"(`{offset}` - pmod(`{offset}`, {block})) div {block}")).cast("long")
    place = {"_file": F.xxhash64("_metadata.file_path"), "_pos": pos}
    packed = stream.select(
        *[F.col(c).alias(f"_s{i}") for i, c in enumerate(seq)],
        number.alias("_block"), F.when(none, F.lit(-1)).otherwise(F.pmod(F.col(offset), F.lit(block))).cast("int").alias("_slot"),
        arrival.alias("_at"), F.unix_millis(arrival).alias("_ms"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("_tie"),
        *[c.alias(k) for k, c in place.items()],
    ).withWatermark("_at", delay)
    marked = packed.withColumn("_lane", F.pmod("_block", F.lit(LANES))).groupBy(*[f"_s{i}" for i in range(len(seq))], "_lane").applyInPandasWithState(
        _mark(block, keep_ms), "_file long, _pos long, _verdict int", "blocks binary", "append", GroupStateTimeout.NoTimeout
    )
    out, marks = f"{root}/out", f"{root}/marks"

    def store(batch: DataFrame, number: int) -> None:
        # written once: the store is not asked again, whatever is read from it
        batch.write.mode("overwrite").parquet(f"{marks}/{number}")
        told = spark.read.schema(batch.schema).parquet(f"{marks}/{number}")
        files = [r[0] for r in told.where(F.col("_verdict") == FILE).select("_file").distinct().collect()]
        if not files:
            return
        # the files of the batch are picked by their path, before any is opened
        rows = spark.read.schema(stream.schema).parquet(path).select(
            *[F.col(c).alias(f"d{i}") for i, c in enumerate(names)], *[c.alias(k) for k, c in place.items()]
        ).where(F.col("_file").isin(files))
        copies = told.where(F.col("_verdict") == AGAIN).select("_file", "_pos")
        ask = told.where(F.col("_verdict") == LOOKUP).select("_file", "_pos")
        if number and not ask.isEmpty():
            keys = [f"d{names.index(c)}" for c in ident]
            old = spark.read.schema(stored).parquet(out).where(f"batch < {number} AND NOT again").select(*[F.col(k).alias(f"o{k}") for k in keys])
            asked = rows.join(ask, ["_file", "_pos"], "left_semi").select("_file", "_pos", *keys)
            cond = F.lit(True)
            for k in keys:
                cond = cond & F.col(k).eqNullSafe(F.col(f"o{k}"))
            copies = copies.unionByName(asked.join(old, cond, "left_semi").select("_file", "_pos"))
        done = rows.join(copies.withColumn("_again", F.lit(True)), ["_file", "_pos"], "left")
        done = done.select(*kept.names, F.coalesce("_again", F.lit(False)).alias("again"), F.lit(number).cast("long").alias("batch"))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "again").parquet(out)
        Files(spark, root).drop(f"marks/{number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = (
            marked.writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        empty = spark.createDataFrame([], stream.select(*names).schema)
        return empty, empty
    done = spark.read.schema(stored).parquet(out)
    once, again = (done.where(c).select(*[F.col(f"d{i}").alias(n) for i, n in enumerate(names)]) for c in ("NOT again", "again"))
    return once, again


def dedupe_table(spark: SparkSession, path: str, files_per_batch: int | None = None, columns: Sequence[str] | None = None, **store: object) -> tuple[DataFrame, DataFrame]:
    """The messages of a table, by (topic, partition, offset), run as a stream in a fresh root, which is not gone on from."""
    root = scratch(spark, "dedupe")
    both = deliver_once(
        spark, path, ["topic", "partition", "offset"], "received_at", "batch_id", root, files_per_batch=files_per_batch, columns=columns, **store
    )
    Files(spark, root).drop("checkpoint")
    return both
