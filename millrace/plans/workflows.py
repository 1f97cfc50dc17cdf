"""Ready-made workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.common import Files
from millrace.functions.records import RECORDS, decode_records, json_objects, typed
from millrace.operators.assemble import assemble, header
from millrace.operators.stateless import Stage
from millrace.operators.substreams import demux
from millrace.plans.pipeline import Sink, pipe
from millrace.sinks.files import manifest, write_slices
from millrace.sinks.queue import FileQueue, hash_partition, to_messages
from millrace.sinks.table import bucket, latest_by_key


def retransmit(partitions: int, preprocess: list[Stage] | None = None, partition: Column | None = None) -> Stage:
    """Topic to topic, partitioned anew by key (or by ``partition``)."""
    target = partition if partition is not None else hash_partition(F.coalesce("key", F.lit(b"")), partitions)
    return pipe(preprocess or [lambda df: df], lambda df: to_messages(df, target))


def chunks_to_files(location: str, preprocess: list[Stage] | None = None, keep: Column | None = None) -> Stage:
    """Slices of objects to the manifest of the files they make."""

    def objects(df: DataFrame) -> DataFrame:
        rows = df if keep is None else df.where(keep)
        return assemble(rows, header("slice_num"), header("slice_cnt"), F.col("value"), header("deleted"))

    return pipe(preprocess or [lambda df: df], objects, lambda o: manifest(o, location))


def retransmit_to(queue: FileQueue, topic: str, partitions: int, preprocess: list[Stage] | None = None, partition: Column | None = None) -> Sink:
    """``foreachBatch`` function: the whole workflow from records to the produced topic, offsets in order of arrival."""
    target = partition if partition is not None else hash_partition(F.coalesce("key", F.lit(b"")), partitions)
    before = pipe(preprocess or [lambda df: df])
    return lambda batch, number: queue.produce(before(batch).withColumn("partition", target.cast("int")), topic, number)


def write_objects(location: str, preprocess: list[Stage] | None = None, keep: Column | None = None, **how: object) -> Stage:
    """Slices of objects to the objects themselves, in files or an object store, as ``location`` says; gives what was written."""

    def objects(df: DataFrame) -> DataFrame:
        rows = df if keep is None else df.where(keep)
        return write_slices(rows, location, header("slice_num").cast("int"), header("slice_cnt").cast("int"), F.col("value"), header("deleted"), **how)

    return pipe(preprocess or [lambda df: df], objects)


def sysmon(df: DataFrame) -> dict[str, DataFrame]:
    """Tagged records to one typed table for each kind; unreadable records are dropped."""
    rows = decode_records(df).where(F.col("tag").isNotNull())
    return {table: typed(rows, tag) for tag, (table, _) in RECORDS.items()}


def sysmon_sink(spark: SparkSession, root: str, days: int = 1, retention_days: int = 30) -> Sink:
    """``foreachBatch`` function of the whole receiver: a batch is decoded once and written by kind, then each
    kind goes to its own table in buckets of ``days``, sorted by time, and buckets past retention are dropped.

    Each batch owns its files in a bucket, so a batch that runs again repeats nothing.
    """
    files = Files(spark, root)

    def sink(batch: DataFrame, number: int) -> None:
        keep = [c for c in ("topic", "partition", "offset") if c in batch.columns]
        decoded = decode_records(batch).where(F.col("tag").isNotNull()).select(*keep, "fields", "tag")
        decoded.write.mode("overwrite").partitionBy("tag").parquet(f"{root}/stage/{number}")
        kinds = [n.removeprefix("tag=") for n in files.names(f"stage/{number}") if n.startswith("tag=")]
        schema = decoded.drop("tag").schema
        for tag in kinds:
            rows = spark.read.schema(schema).parquet(f"{root}/stage/{number}/tag={tag}").withColumn("tag", F.lit(tag))
            table = RECORDS[tag][0]
            out = typed(rows, tag).withColumns({"bucket": bucket(F.col("ts"), days), "batch": F.lit(number)})
            out = out.where("bucket IS NOT NULL").sortWithinPartitions("bucket", "ts")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{root}/{table}")
            newest = max((int(n[7:]) for n in files.names(table) if n.startswith("bucket=")), default=None)
            for n in files.names(table):
                if n.startswith("bucket=") and newest is not None and int(n[7:]) < newest - retention_days:
                    files.drop(f"{table}/{n}")
        files.drop(f"stage/{number}")

    return sink


def sysmon_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the receiver as it is; empty before its first record."""
    tag = next(t for t, (n, _) in RECORDS.items() if n == table)
    schema = StructType.fromDDL("topic string, partition int, offset long, " + RECORDS[tag][1])
    if not Files(spark, root).names(table):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{table}").select(*schema.names)


def json_upsert(schema: str, keys: list[str]) -> Stage:
    """JSON values, split by key, to the last version of each key."""

    def decode(df: DataFrame) -> DataFrame:
        rows = json_objects(df.select("topic", "partition", "offset", "ord", "route", "key", "value"), schema)
        return rows.drop("value")

    return pipe(decode, demux(F.col("key")), lambda d: latest_by_key(d.drop("route"), keys))
