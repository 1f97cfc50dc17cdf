"""Positions of a consumer group: the offsets that are safe to go on from, kept in the shared folder.

Commits only grow: a position below the one before is counted as a regression and changes nothing. As
a queue stores the next offset to read, the positions are one above the committed offsets.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.common import Files


class OffsetStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.regressions = spark, Files(spark, root), 0

    def _last(self) -> tuple[int, list[list]]:
        done = [int(n) for n in self.files.names("positions") if n.isdigit()]
        return (max(done), self.files.read(f"positions/{max(done)}")) if done else (-1, [])

    def positions(self) -> dict[tuple[str, int], int]:
        """Next offset of each topic and partition."""
        return {(t, p): n for t, p, n in self._last()[1]}

    def commit(self, committed: DataFrame) -> dict[tuple[str, int], int]:
        """Takes ``(topic, partition, committed)``, one row for each partition, and returns the new positions."""
        number, _ = self._last()
        now = self.positions()
        for r in committed.where("committed IS NOT NULL").select("topic", "partition", "committed").collect():
            key, nxt = (r["topic"], r["partition"]), r["committed"] + 1
            if nxt < now.get(key, 0):
                self.regressions += 1
                logging.getLogger("millrace").error("%s: commit of %s below %s", key, nxt, now[key])
            else:
                now[key] = nxt
        self.files.write(f"positions/{number + 1}", [[t, p, n] for (t, p), n in now.items()])
        if number > 0:
            self.files.drop(f"positions/{number - 1}")
        return now

    def commit_rows(self, batch: DataFrame) -> dict[tuple[str, int], int]:
        """Commits the highest offset of each partition of a batch whose rows are all done."""
        return self.commit(batch.groupBy("topic", "partition").agg(F.max("offset").alias("committed")))

    def starting_offsets(self) -> str:
        """For the queue source: the positions as JSON, or ``earliest`` while there are none."""
        out: dict[str, dict[str, int]] = {}
        for (t, p), n in self.positions().items():
            out.setdefault(t, {})[str(p)] = n
        return json.dumps(out, sort_keys=True) if out else "earliest"

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([(t, p, n) for (t, p), n in self.positions().items()], "topic string, partition int, position long")
