"""File and in-memory sources, and a source of the user's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.envelope import with_envelope
from millrace.streaming.dedupe import source as stream_files


def table_source(spark: SparkSession, path: str, topic: Column | str, partition: Column, offset: Column) -> DataFrame:
    """Batch of a parquet table; the end of the table is the end of input."""
    return with_envelope(spark.read.parquet(path), topic, partition, offset)


def stream_source(spark: SparkSession, path: str, topic: Column | str, partition: Column, offset: Column, files: int | None = None) -> DataFrame:
    return with_envelope(stream_files(spark, path, files), topic, partition, offset)


def feed(spark: SparkSession, rows: Iterable[tuple], schema: str, topic: str = "feed") -> DataFrame:
    """A finite list of messages as input; offsets count from 1, in one partition."""
    from pyspark.sql import functions as F

    listed = [(i + 1, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(listed, f"_n long, {schema}")
    return with_envelope(df, topic, F.lit(0), F.col("_n")).drop("_n")


def make_source(name: str, schema: str, partitions: int, rows: Callable[[int, dict], Iterator[tuple]]) -> type[DataSource]:
    """A source from a function of (partition number, options); register it with ``spark.dataSource.register``."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = dict(options)

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(i) for i in range(partitions)]

        def read(self, part: InputPartition) -> Iterator[tuple]:
            yield from rows(part.value, self.options)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> Reader:  # noqa: ANN001, ARG002
            return Reader(self.options)

    return Source
