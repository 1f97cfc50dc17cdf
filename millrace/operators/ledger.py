"""Processing only new or changed records: a ledger of work items.

A lane is one topic and partition. What is not yet covered in a lane is cut into work items,
ranges of offsets that form a chain: item n begins after the end of item n - 1 (or after what the
log covers, if that is more). An item is registered by creating the file of its number
exclusively, so of two runs that plan at the same time one wins, the other goes on from there,
and no two items overlap however the data grow between the runs. Every item is a folder:

* ``pending``  no live lease and no ``done`` file,
* ``leased``   the newest ``lease-<token>`` file has not expired; tokens only grow,
* ``done``     a ``done`` file naming the token that committed it.

An expired lease returns its item to pending; the next lease has a higher fencing token, and a
commit with an older token is rejected. The output of an item goes to a path that follows from
item and token: attempts under the same token overwrite each other, and a stale writer that
finishes late writes where nobody reads. A ``base`` file of a lane tells up to which item all are
done, so a run looks at open and new items only, not at the history.

Defined cases: partitions without any success start at their first offset; failed, unfinished
and repeated log rows change nothing; null to_offset of a succeeded row covers nothing; an
empty log covers nothing; an empty table yields no items; a null topic or partition is a lane
like any other; records with a null offset have no place in a lane and are left out; records that
turn up below the end of the chain later are not new to the queue and are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Offsets of one work item; items of one run are processed together, as one job.
ITEM_OFFSETS = 50_000_000
#: Calls to the file system at a time.
CALLS = 16


def covered(log: DataFrame) -> DataFrame:
    """Highest offset of each topic and partition that a succeeded run reached."""
    return log.where(F.col("status") == "succeeded").groupBy("topic", "partition").agg(F.max("to_offset").alias("done_to"))


def open_ends(data: DataFrame, log: DataFrame) -> DataFrame:
    """``(topic, partition, from_offset, to_offset)``: one row for each lane with offsets above the covered ones."""
    ends = data.groupBy("topic", "partition").agg(F.min("offset").alias("_lo"), F.max("offset").alias("_hi"))
    c = covered(log).select(F.col("topic").alias("_t"), F.col("partition").alias("_p"), "done_to")
    todo = ends.join(c, ends["topic"].eqNullSafe(c["_t"]) & ends["partition"].eqNullSafe(c["_p"]), "left")
    start = F.greatest(F.col("_lo"), F.col("done_to") + 1)
    todo = todo.select("topic", "partition", start.cast("long").alias("from_offset"), F.col("_hi").cast("long").alias("to_offset"))
    return todo.where("from_offset <= to_offset")


def plan_items(data: DataFrame, log: DataFrame, item_offsets: int = ITEM_OFFSETS) -> DataFrame:
    """The items of a first run: the open offsets of each lane in ranges cut at multiples of ``item_offsets``."""
    step = F.lit(item_offsets)
    cuts = F.sequence(F.floor(F.col("from_offset") / step), F.floor(F.col("to_offset") / step))
    return open_ends(data, log).select("topic", "partition", F.col("from_offset").alias("_a"), F.col("to_offset").alias("_z"), F.explode(cuts).alias("_c")).select(
        "topic", "partition",
        F.greatest(F.col("_a"), F.col("_c") * step).cast("long").alias("from_offset"),
        F.least(F.col("_z"), (F.col("_c") + 1) * step - 1).cast("long").alias("to_offset"),
    )


@dataclass(frozen=True)
class Item:
    """A range of offsets of one lane, by its number in the lane's chain."""

    lane: str
    number: int
    topic: str | None
    partition: int | None
    from_offset: int
    to_offset: int

    @property
    def name(self) -> str:
        return f"{self.lane}-{self.number:012d}"


@dataclass(frozen=True)
class Lease:
    item: Item
    token: int
    expires: float


class StaleWriter(RuntimeError):
    """The lease of this writer has been taken over, or the item is already done."""


class Ledger:
    """Work items in the shared file system (any Hadoop file system with exclusive create)."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _create(self, path: str, body: dict) -> bool:
        """Writes a small file that must not exist yet."""
        try:
            out = self.fs.create(self._path(path), False)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(json.dumps(body).encode())
        out.close()
        return True

    def _exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def _read(self, path: str) -> dict:
        """The body of a file; one that is just being written is waited for."""
        for _ in range(50):
            stream = self.fs.open(self._path(path))
            try:
                text = self._io.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text:
                return json.loads(text)
            time.sleep(0.1)
        return {}

    def _names(self, folder: str, prefix: str) -> list[int]:
        at = self._path(folder)
        if not self.fs.exists(at):
            return []
        return sorted(int(n[len(prefix) :]) for s in self.fs.listStatus(at) if (n := s.getPath().getName()).startswith(prefix))

    @staticmethod
    def lane(topic: str | None, partition: int | None) -> str:
        """A name for paths; a digest keeps apart what is spelled alike."""
        plain = re.sub(r"[^A-Za-z0-9.]+", "_", f"{topic}_{partition}")[:80]
        return f"{plain}_{hashlib.sha256(repr((topic, partition)).encode()).hexdigest()[:12]}"

    def _folder(self, lane: str, number: int) -> str:
        return f"{self.root}/lanes/{lane}/{number // 1000:09d}/{number:012d}"

    def _at(self, item: Item) -> str:
        return self._folder(item.lane, item.number)

    def _base(self, lane: str) -> int:
        """The number up to which all items are done."""
        return max(self._names(f"{self.root}/lanes/{lane}/bases", "base-"), default=0)

    def chain(self, lane: str, start: int | None = None) -> list[Item]:
        """The items of a lane from number ``start`` on, by default from its first open one and the one before."""
        number, out = max(1, self._base(lane)) if start is None else start, []
        while b := self._body(lane, number)[1]:
            out.append(Item(lane, number, b["topic"], b["partition"], b["from_offset"], b["to_offset"]))
            number += 1
        return out

    def _body(self, lane: str, number: int) -> tuple[str, dict]:
        """The file that registers an item, and its body; empty if there is none yet.

        A run that dies between making the file and filling it leaves it empty; the next one then counts.
        """
        at = f"{self._folder(lane, number)}/item"
        while self._exists(at):
            if body := self._read(at):
                return at, body
            at += "-"
        return at, {}

    def add(self, topic: str | None, partition: int | None, from_offset: int, to_offset: int, step: int = ITEM_OFFSETS) -> None:
        """Registers what is left of a range as the next items of the lane; what the chain holds already is left out."""
        lane = self.lane(topic, partition)
        while True:
            held = self.chain(lane)
            last = held[-1] if held else None
            a = max(from_offset, last.to_offset + 1) if last else from_offset
            if a > to_offset:
                return
            number = last.number + 1 if last else 1
            body = {"topic": topic, "partition": partition, "from_offset": a, "to_offset": min(to_offset, (a // step + 1) * step - 1)}
            self._create(self._body(lane, number)[0], body)  # another run may have been faster: look again

    def _newest(self, item: Item) -> tuple[int, float]:
        tokens = self._names(self._at(item), "lease-")
        return (tokens[-1], self._read(f"{self._at(item)}/lease-{tokens[-1]}").get("expires", 0.0)) if tokens else (0, 0.0)

    def state(self, item: Item) -> str:
        if self._exists(f"{self._at(item)}/done"):
            return "done"
        token, expires = self._newest(item)
        return "leased" if token and expires > self.clock() else "pending"

    def lease(self, item: Item, seconds: float) -> Lease | None:
        """Takes a pending item; None if it is leased or done, or another worker was faster."""
        if self.state(item) != "pending":
            return None
        token, expires = self._newest(item)[0] + 1, self.clock() + seconds
        return Lease(item, token, expires) if self._create(f"{self._at(item)}/lease-{token}", {"expires": expires}) else None

    def check(self, lease: Lease) -> None:
        """Rejects a writer whose token is no longer the newest."""
        if self._newest(lease.item)[0] != lease.token or self.state(lease.item) == "done":
            raise StaleWriter(f"{lease.item.name}: token {lease.token} is stale")

    def commit(self, lease: Lease) -> None:
        self.check(lease)
        if not self._create(f"{self._at(lease.item)}/done", {"token": lease.token}):
            raise StaleWriter(f"{lease.item.name} is already done")

    def advance(self, lane: str) -> None:
        """Moves the base of a lane over the done items that follow it."""
        base = self._base(lane)
        top = base
        while self._exists(f"{self._folder(lane, top + 1)}/done"):
            top += 1
        if top > base:
            self._create(f"{self.root}/lanes/{lane}/bases/base-{top:012d}", {})

    def _token(self, item: Item) -> int:
        """The token that committed an item; of a writer that died between making the file and filling it, the newest."""
        return self._read(f"{self._at(item)}/done").get("token") or self._newest(item)[0]

    def lanes(self) -> list[str]:
        at = self._path(f"{self.root}/lanes")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def folder(self, item: Item, token: int) -> str:
        """Where the output of an item under a token lies."""
        return f"{self.root}/out/item={item.name}/token={token}"

    def read(self, items: Sequence[Item], schema: T.StructType) -> DataFrame:
        """The committed output of done items."""
        with ThreadPoolExecutor(CALLS) as pool:
            paths = list(pool.map(lambda i: self.folder(i, self._token(i)), items))
            paths = [p for p, there in zip(paths, pool.map(self._exists, paths), strict=True) if there]
        if not paths:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([T.StructField(f"d{i}", f.dataType) for i, f in enumerate(schema.fields)])
        rows = self.spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(*paths)
        return rows.select(*[F.col(f"d{i}").alias(n) for i, n in enumerate(schema.names)])

    def done(self) -> list[Item]:
        """All done items; it goes through the whole history."""
        return [i for lane in self.lanes() for i in self.chain(lane, 1) if self.state(i) == "done"]


def write_items(ledger: Ledger, data: DataFrame, leases: Sequence[Lease], step: int = ITEM_OFFSETS) -> None:
    """Writes the records of the leased items as one job, each item to the folder of its token."""
    spark = ledger.spark
    work = spark.createDataFrame(
        [(x.item.name, x.token, x.item.topic, x.item.partition, c, x.item.from_offset, x.item.to_offset)
         for x in leases for c in range(x.item.from_offset // step, x.item.to_offset // step + 1)],
        "item string, token int, _t string, _p int, _c long, _a long, _b long",
    )
    # broadcast by AQE while the items are below the session's threshold; beyond it the range
    # number is part of the key, so a partition with most of the records is still spread
    # plain names for the columns of the data, so that none clashes with the ledger's own
    kept = {f"d{i}": F.col(c) for i, c in enumerate(data.columns)}
    keys = {"_topic": F.col("topic"), "_partition": F.col("partition"), "_offset": F.col("offset")}
    rows = data.select(*[c.alias(k) for k, c in (kept | keys).items()])
    rows = rows.withColumn("_r", F.expr(f"(_offset - pmod(_offset, {step})) div {step}")).join(
        work,
        F.col("_topic").eqNullSafe(F.col("_t")) & F.col("_partition").eqNullSafe(F.col("_p")) & (F.col("_r") == F.col("_c"))
        & F.col("_offset").between(F.col("_a"), F.col("_b")),
    )
    out = rows.select(*kept, "item", "token")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("item", "token").parquet(f"{ledger.root}/out")


def run_items(ledger: Ledger, data: DataFrame, seconds: float = 3600.0, step: int = ITEM_OFFSETS, lanes: Sequence[str] | None = None) -> list[Item]:
    """Leases all pending items, writes and commits them; returns the items this call has committed.

    An item whose lease was taken over in the meantime is left to the one who took it.
    """
    lanes = ledger.lanes() if lanes is None else lanes
    with ThreadPoolExecutor(CALLS) as pool:
        items = [i for chain in pool.map(ledger.chain, lanes) for i in chain]
        leases = [x for x in pool.map(lambda i: ledger.lease(i, seconds), items) if x]
        if not leases:
            return []
        write_items(ledger, data, leases, step)

        def commit(lease: Lease) -> bool:
            try:
                ledger.commit(lease)
            except StaleWriter:
                return False
            return True

        mine = [x.item for x, ok in zip(leases, pool.map(commit, leases), strict=True) if ok]
        list(pool.map(ledger.advance, sorted({i.lane for i in mine})))
    return mine


def process_new(
    spark: SparkSession, data: DataFrame, log: DataFrame, root: str, item_offsets: int = ITEM_OFFSETS,
    clock: Callable[[], float] = time.time, seconds: float = 3600.0,
) -> DataFrame:
    """Plans, leases, processes and commits what earlier runs left; returns the records this run has committed.

    The driver sees one row for each lane, and names of open items, whose number is bounded by
    topics x partitions x new offsets / ``item_offsets``; never records.
    """
    ledger = Ledger(spark, root, clock)
    with ThreadPoolExecutor(CALLS) as pool:
        ends = open_ends(data, log).collect()
        list(pool.map(lambda r: ledger.add(r["topic"], r["partition"], r["from_offset"], r["to_offset"], item_offsets), ends))
    return ledger.read(run_items(ledger, data, seconds, item_offsets), data.schema)
