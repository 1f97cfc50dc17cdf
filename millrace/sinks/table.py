"""Table sinks: insert, upsert by key, renamed columns, rotated range partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.common import ship


def latest_by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last write of each key in order of offset; what an upsert leaves of a batch."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[c for c in ("offset", "ord") if c in df.columns])
    # an aggregate combines map-side, so a key with most of the rows does not gather in one task
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table after the batch: rows of ``target`` without a new version, and the last new versions."""
    new = latest_by_key(batch, keys)
    marked = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & target[k].eqNullSafe(marked[f"_k{i}"])
    return target.join(marked, cond, "left_anti").unionByName(new.select(*target.columns))


def map_columns(df: DataFrame, fields: Sequence[str], mapping: dict[str, str] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """Fields in the order of the table, renamed by ``mapping`` (source to column). ``_offset`` is
    the offset of the record; a null in a required field is an error."""
    source = {v: k for k, v in (mapping or {}).items()}

    def one(f: str) -> Column:
        c = F.col("offset") if f == "_offset" else F.col(source.get(f, f))
        if f in required:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"missing data: {f}"))).otherwise(c)
        return c.alias(f)

    return df.select(*[one(f) for f in fields])


#: Days from the beginning of year 0 to the beginning of 1970.
GREGORIAN_EPOCH = 719_528


def bucket(day: Column, days: int) -> Column:
    """First day number (from year 0) of the range partition of a date."""
    g = F.unix_date(day.cast("date")) + GREGORIAN_EPOCH
    return (g - F.pmod(g, F.lit(days))).cast("int")


def bucket_date(b: Column) -> Column:
    return F.date_from_unix_date(b - GREGORIAN_EPOCH)


def planned_buckets(today: Column, days: int, ahead: int = 3, behind: int = 0) -> Column:
    """Array of the buckets that must exist today."""
    b = bucket(today, days)
    return F.sequence(b - behind * days, b + ahead * days, F.lit(days))


def expired(b: Column, today: Column, days: int, retention_days: int) -> Column:
    return b < bucket(today, days) - retention_days


def write_rotated(df: DataFrame, ts: str, path: str, days: int, index: Sequence[str] = ()) -> None:
    """Appends to a table of bucket folders; a query on a range of time prunes to its folders.

    ``index``: columns the files are sorted by, so that their statistics leave out what a filter on them does not need.
    """
    rows = df.withColumn("bucket", bucket(F.col(ts), days))
    rows = rows.sortWithinPartitions("bucket", *index) if index else rows
    rows.write.mode("append").partitionBy("bucket").parquet(path)


def ensure_buckets(spark, path: str, today: str, days: int, retention_days: int, ahead: int = 3, behind: int = 0) -> tuple[list[str], list[str]]:  # noqa: ANN001
    """Makes the folders of the buckets that must exist today and drops those past retention; returns (made, dropped)."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    need = spark.range(1).select(planned_buckets(F.lit(today), days, ahead, behind).alias("b")).first()["b"]
    made = []
    for b in need:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        if not fs.exists(at):
            fs.mkdirs(at)
            made.append(f"bucket={b}")
    return made, drop_expired(path, spark, today, days, retention_days)


def drop_expired(df_path: str, spark, today: str, days: int, retention_days: int) -> list[str]:  # noqa: ANN001
    """Deletes the bucket folders past retention; returns their names."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(df_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    limit = spark.range(1).select((bucket(F.lit(today), days) - retention_days).alias("b")).first()["b"]
    gone = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("bucket=") and int(name[7:]) < limit:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


def jdbc_writer(url: str, table: str, batch_size: int = 1000, **properties: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that appends to a database table; the driver jar is the user's."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch_size, **properties).mode("append").save()

    return write


def upsert_statement(table: str, fields: Sequence[str], keys: Sequence[str]) -> str:
    """SQL of an upsert of one row; fields that are no keys take the new values."""
    rest = [f for f in fields if f not in keys]
    action = "UPDATE SET " + ", ".join(f"{f} = EXCLUDED.{f}" for f in rest) if rest else "NOTHING"
    marks = ", ".join("?" for _ in fields)
    tail = f" ON CONFLICT ({', '.join(keys)}) DO {action}" if keys else ""
    return f"INSERT INTO {table} ({', '.join(fields)}) VALUES ({marks}){tail}"


def write_rows(
    df: DataFrame, connect: Callable[[], object], table: str, fields: Sequence[str], keys: Sequence[str] = (), mapping: dict[str, str] | None = None,
    required: Sequence[str] = (), mark: str = "?", batch_size: int = 1000,
) -> DataFrame:
    """Writes rows to a database through its Python driver and returns ``(n_rows)`` of each task.

    ``connect`` makes a connection (DB-API) inside a task. With ``keys`` rows are upserted: the last
    version of each key by offset, so no two tasks write the same key; without, they are inserted. Each
    batch of rows is one transaction, and every row must be taken, else the task fails.
    """
    ship(df.sparkSession)
    rows = latest_by_key(df, [{v: k for k, v in (mapping or {}).items()}.get(k, k) for k in keys]) if keys else df
    rows = map_columns(rows, fields, mapping, required)
    statement = upsert_statement(table, fields, keys).replace("?", mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, n = None, 0
        try:
            for batch in batches:
                link = link or connect()
                values = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                for i in range(0, len(values), batch_size):
                    part = values[i : i + batch_size]
                    cursor = link.cursor()
                    for row in part:
                        cursor.execute(statement, row)
                        if cursor.rowcount not in (1, -1):
                            raise RuntimeError(f"{table}: a row was not taken")
                    link.commit()
                    n += len(part)
        finally:
            if link is not None:
                link.close()
        yield pa.RecordBatch.from_pydict({"n_rows": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "n_rows long")
