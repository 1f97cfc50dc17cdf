"""Objects to files and object stores, and external commands."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.common import ship
from millrace.operators.assemble import transfers


def object_path(location: str, key: Column) -> Column:
    return F.concat_ws("/", F.lit(location.rstrip("/")), key.cast("string"))


def manifest(objects: DataFrame, location: str) -> DataFrame:
    """What writing the assembled objects would leave: path, deleted, retransmission, offset, n_bytes."""
    return objects.select(
        object_path(location, F.col("key")).alias("path"), "offset", "deleted", "retransmission",
        F.when(~F.col("retransmission") & ~F.col("deleted"), F.octet_length("content")).alias("n_bytes"),
    )


class Upload(Protocol):
    def part(self, data: bytes) -> None: ...
    def complete(self) -> None: ...
    def abort(self) -> None: ...


class Store(Protocol):
    """Where objects go: a small object is put at once, a large one in parts that appear together or not at all."""

    def put(self, path: str, data: bytes) -> None: ...
    def begin(self, path: str) -> Upload: ...
    def delete(self, path: str) -> None: ...


class FileStore:
    """Files of any file system that pyarrow knows by its URI: folders all executors have mounted, HDFS, object
    stores (whose output streams are multipart uploads)."""

    def __init__(self, root: str = "file:///"):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(root)
        self.moves = self.fs.type_name in ("local", "hdfs")

    def begin(self, path: str) -> Upload:
        store, at = self, path.split("://", 1)[-1] if "://" in path else path
        # where a rename is atomic the file gets its name at the end; an object store completes the upload then
        part = f"{at}.part" if self.moves else at
        if self.moves:
            self.fs.create_dir(part.rsplit("/", 1)[0], recursive=True)

        class Open:
            def __init__(self) -> None:
                self.out = store.fs.open_output_stream(part)

            def part(self, data: bytes) -> None:
                self.out.write(data)

            def complete(self) -> None:
                self.out.close()
                if store.moves:
                    store.fs.move(part, at)

            def abort(self) -> None:
                if store.moves:
                    self.out.close()
                    store.fs.delete_file(part)

        return Open()

    def put(self, path: str, data: bytes) -> None:
        up = self.begin(path)
        up.part(data)
        up.complete()

    def delete(self, path: str) -> None:
        at = path.split("://", 1)[-1] if "://" in path else path
        if self.fs.get_file_info(at).is_file:
            self.fs.delete_file(at)


#: Bytes of one part of an upload.
PART = 5 << 20


def write_slices(
    df: DataFrame, location: str, num: Column, cnt: Column, content: Column, deleted: Column | None = None,
    store: Callable[[], Store] = FileStore, part_bytes: int = PART,
) -> DataFrame:
    """Brings each key's object to the state its last ended, fresh transfer says, slice by slice; returns
    ``(path, offset, deleted, n_bytes, n_parts)`` of what was done.

    Earlier transfers of a key would be overwritten, so their contents are not sent around. A task has
    the slices of one object in order and holds one part of it, so objects of any size are written. The
    last slice completes the upload; one that breaks off is aborted, and a task that runs again
    leaves the same files.
    """
    ship(df.sparkSession)
    flag = F.coalesce(deleted, F.lit("0")) == "1" if deleted is not None else F.lit(False)
    keys = ["topic", "partition", "key"]
    d = transfers(df.select(*keys, "offset", "ord", num.alias("_n"), cnt.alias("_c"), content.alias("_content"), flag.alias("_del")), F.col("_n"), F.col("_c"))
    ended = d.groupBy(*keys, "transfer").agg(F.max("offset").alias("_end"), F.max(F.col("_num") == F.col("_cnt")).alias("_ended"), F.max("is_fresh").alias("_fresh"))
    last = ended.where("_ended AND _fresh").groupBy(*keys).agg(F.max("transfer").alias("_last"))
    last = last.select(*[F.col(k).alias(f"_l{k}") for k in keys], "_last")
    cond = F.col("transfer") == F.col("_last")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_l{k}"))
    rows = d.join(last, cond).where("is_taken OR _num = _cnt").select(
        object_path(location, F.col("key")).alias("path"), "offset", "ord", (F.col("_del") & (F.col("_num") == 1)).alias("deleted"),
        F.when(F.col("is_taken"), F.col("_content")).alias("content"), (F.col("_num") == F.col("_cnt")).alias("is_last"),
    )
    rows = rows.repartition("path").sortWithinPartitions("path", "offset", "ord").drop("ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = store()
        up, held, size, parts, gone = None, bytearray(), 0, 0, False
        try:
            for batch in batches:
                out = []
                for path, offset, is_del, content, is_last in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "deleted", "content", "is_last")), strict=True):
                    gone = gone or is_del
                    held += content or b""
                    size += len(content or b"")
                    while len(held) >= part_bytes and not gone:
                        up = up or to.begin(path)
                        up.part(bytes(held[:part_bytes]))
                        parts += 1
                        del held[:part_bytes]
                    if is_last:
                        if gone:
                            to.delete(path)
                        elif up is None:
                            to.put(path, bytes(held))
                        else:
                            if held:
                                up.part(bytes(held))
                                parts += 1
                            up.complete()
                        out.append((path, offset, gone, 0 if gone else size, parts))
                        up, held, size, parts, gone = None, bytearray(), 0, 0, False
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "offset", "deleted", "n_bytes", "n_parts"])
        finally:
            if up is not None:
                up.abort()

    return rows.mapInArrow(run, "path string, offset long, deleted boolean, n_bytes long, n_parts int")


def retry(call: Callable[[], Any], times: int = 3, sleep_ms: int = 3000) -> Any:
    """Calls until it succeeds, at most ``times`` more times after the first failure."""
    for left in range(times, -1, -1):
        try:
            return call()
        except Exception:
            if not left:
                raise
            time.sleep(sleep_ms / 1000)
    return None


def execute(program: str, args: list[str], log: Callable[[str], None] = print) -> int:
    """Runs an external command, hands its output lines to ``log`` and returns its exit status."""
    run = subprocess.Popen([program, *args], stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True)
    for line in run.stdout or ():
        log(line.rstrip("\n"))
    return run.wait()
