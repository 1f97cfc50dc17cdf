"""Message-queue sinks: key, value, headers and an explicit partition are kept.

``write_queue`` and ``queue_sink`` write through the queue's connector, which must be on the class
path. ``FileQueue`` is a queue in a shared folder with the same columns and rules; it glues
pipelines together where there is no broker, and stands for one in tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.common import Files
from millrace.operators import blocks

MESSAGE = "topic string, partition int, offset long, key binary, value binary, headers array<struct<key:string,value:binary>>"


def hash_partition(key: Column, n: int) -> Column:
    """Partition of a key; the same for the same key, whatever the input partition."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def to_messages(df: DataFrame, partition: Column) -> DataFrame:
    cols = [F.col(c) for c in ("key", "value", "headers") if c in df.columns]
    return df.select(*cols, partition.cast("int").alias("partition"))


def produce_options(topic: str, acks: str = "all", timeout_ms: int = 10_000, retries: int = 10, **client: str) -> dict[str, str]:
    return {
        "topic": topic, "kafka.acks": acks, "kafka.request.timeout.ms": str(timeout_ms), "kafka.retries": str(retries), "includeHeaders": "true",
        **client,
    }


def write_queue(df: DataFrame, topic: str, connector: str = "kafka", **options: str) -> None:
    """Produces the rows of ``df`` (key, value, headers, partition); returns when the queue has acknowledged them."""
    df.write.format(connector).options(**produce_options(topic, **options)).mode("append").save()


def queue_sink(topic: str, partition: Column, connector: str = "kafka", **options: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that produces each batch; a failure fails the batch, which then runs again."""
    return lambda batch, number: write_queue(to_messages(batch, partition), topic, connector, **options)


class FileQueue:
    """Topics in a shared folder: partitions with dense growing offsets, produced batch by batch.

    A batch owns a folder, and counts once a small file with the next offsets is there, so a batch
    that is produced again after a failure repeats nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    def heads(self, topic: str, before: int | None = None) -> tuple[int, dict[str, int]]:
        """Number of the last batch and the next offset of each partition."""
        done = [int(n) for n in self.files.names(f"{topic}/heads") if n.isdigit() and (before is None or int(n) < before)]
        return (max(done), self.files.read(f"{topic}/heads/{max(done)}")) if done else (-1, {})

    def produce(self, df: DataFrame, topic: str, number: int | None = None) -> None:
        """Appends key, value, headers in order of ``offset`` (and ``ord``) inside each ``partition``."""
        last, heads = self.heads(topic, number)
        number = last + 1 if number is None else number
        if self.files.exists(f"{topic}/heads/{number}"):
            return
        order = [c for c in ("offset", "ord") if c in df.columns]
        rows = blocks.running(df.where("partition IS NOT NULL"), ["partition"], order, F.lit(1), "_rn")
        known = [F.lit(x) for p, n in heads.items() for x in (int(p), n)]
        start = F.coalesce(F.create_map(*known)[F.col("partition")], F.lit(0)) if known else F.lit(0)
        fields = {c: F.col(c) if c in df.columns else F.lit(None) for c in ("key", "value", "headers")}
        kinds = {"key": "binary", "value": "binary", "headers": "array<struct<key:string,value:binary>>"}
        out = rows.select("partition", (start + F.col("_rn")).cast("long").alias("offset"), *[x.cast(kinds[c]).alias(c) for c, x in fields.items()])
        at = f"{self.root}/{topic}/data/batch={number}"
        out.write.mode("overwrite").parquet(at)
        ends = self.spark.read.parquet(at).groupBy("partition").agg((F.max("offset") + 1).alias("n")).collect()
        self.files.write(f"{topic}/heads/{number}", heads | {str(r["partition"]): r["n"] for r in ends})

    def sink(self, topic: str, partition: Column) -> Callable[[DataFrame, int], None]:
        return lambda batch, number: self.produce(batch.withColumn("partition", partition.cast("int")), topic, number)

    def read(self, topic: str) -> DataFrame:
        """All messages of the batches that are whole."""
        done = [n for n in self.files.names(f"{topic}/heads") if n.isdigit()]
        if not done:
            return self.spark.createDataFrame([], MESSAGE)
        fields = MESSAGE.removeprefix("topic string, ")
        rows = self.spark.read.schema(fields).parquet(*[f"{self.root}/{topic}/data/batch={n}" for n in done])
        return rows.select(F.lit(topic).alias("topic"), "*")

    def stream(self, topic: str) -> DataFrame:
        """Messages as a stream; begin it when the first batch is there."""
        rows = self.spark.readStream.schema(MESSAGE.removeprefix("topic string, ")).option("recursiveFileLookup", "true").parquet(f"{self.root}/{topic}/data")
        return rows.select(F.lit(topic).alias("topic"), "*")
