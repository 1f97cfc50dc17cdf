"""Session helpers shared by all operators."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory; Catalyst prunes its columns at the scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session that has none gets a temporary folder; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    sc = spark.sparkContext._jsc.sc()
    if not conf:
        current = sc.getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="millrace-")
    if not sc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; ``clean`` removes it again."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    spark.sparkContext.__dict__.setdefault("_millrace_scratch", []).append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Deletes the scratch folders of this session, when none of the results that lie there is needed any more."""
    paths = spark.sparkContext.__dict__.pop("_millrace_scratch", [])
    for p in paths:
        Files(spark, p).drop("")
    return len(paths)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-code-"), "millrace.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._millrace_shipped = True


class Files:
    """Small files of the driver in the shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.root, self._path, self._io = root, jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{name}"))

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def write(self, name: str, body: object) -> None:
        """Writes a file under another name first, so that a reader finds it whole or not at all."""
        part, at = self._path(f"{self.root}/{name}.part"), self._path(f"{self.root}/{name}")
        out = self.fs.create(part, True)
        out.write(json.dumps(body).encode())
        out.close()
        self.fs.delete(at, False)
        self.fs.rename(part, at)

    def read(self, name: str) -> object:
        stream = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}".rstrip("/")), True)
