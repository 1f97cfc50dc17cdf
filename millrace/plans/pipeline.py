"""Pipelines and workflows: a list of stages, a source and a sink, run as batch or as stream."""

from __future__ import annotations

import html
import importlib.util
import json
import logging
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import chunking, stateless, substreams
from millrace.operators.assemble import assemble_by
from millrace.operators.stateless import Stage
from millrace.sinks.commit import OffsetStore
from millrace.sources.queue import read_queue


def pipe(*stages: Stage | Sequence[Stage]) -> Stage:
    """One stage from several; nested lists are allowed, an empty pipe is an error."""
    flat: list[Stage] = []
    for s in stages:
        flat += list(s) if isinstance(s, (list, tuple)) else [s]
    if not flat:
        raise ValueError("a pipe needs at least one stage")

    def run(df: DataFrame) -> DataFrame:
        for s in flat:
            df = df.transform(s)
        return df

    return run


_FORMS: dict[str, Callable[..., Stage]] = {
    "map": stateless.map_rows, "filter": stateless.filter_rows, "mfd": stateless.map_filter_route, "unfold": stateless.unfold,
    "demux": substreams.demux, "join": substreams.join_streams, "route_dependent": substreams.route_stages,
    "chunk": chunking.chunk_by_count, "buffer": chunking.chunk_by_size, "aggregate": chunking.aggregate_by, "assemble_chunks": assemble_by,
}


def node(spec: Any) -> Stage:
    """A stage from any of its forms: a function of a DataFrame, a name, ``(name, arguments)`` or
    ``(name, arguments, options)``. Arguments are a dict, a tuple or one value; the option
    ``partitions`` spreads the input of the stage anew."""
    if callable(spec):
        return spec
    name, args, options = (spec, (), {}) if isinstance(spec, str) else (*spec, {})[:3]
    if name not in _FORMS:
        raise ValueError(f"no stage is called {name}")
    stage = _FORMS[name](**args) if isinstance(args, dict) and name != "route_dependent" else _FORMS[name](*(args if isinstance(args, tuple) else (args,)))
    return (lambda df: stage(df.repartition(options["partitions"]))) if options.get("partitions") else stage


Sink = Callable[[DataFrame, int], None]


@dataclass
class Workflow:
    """A named pipe with its source. ``checkpoint`` None: progress is not kept.

    ``commit`` says who commits to ``positions``: ``auto`` does it after the sink is done with a batch,
    ``user`` leaves it to the sink (``positions.commit``), ``never`` commits nothing.
    """

    name: str
    source: Callable[[SparkSession], DataFrame]
    stages: Sequence[Any]
    checkpoint: str | None = None
    options: dict[str, Any] = field(default_factory=dict)
    commit: str = "auto"
    positions: OffsetStore | None = None

    def plan(self, spark: SparkSession) -> DataFrame:
        return self.source(spark).transform(pipe([node(s) for s in self.stages]))

    def start(self, spark: SparkSession, sink: Sink) -> StreamingQuery:
        """Starts the stream; ``flush_seconds`` in the options sets the interval of batches, else it runs to the present end."""
        if self.commit not in ("auto", "user", "never"):
            raise ValueError(f"commit must be auto, user or never, not {self.commit}")

        def each(batch: DataFrame, number: int) -> None:
            sink(batch, number)
            if self.commit == "auto" and self.positions is not None:
                self.positions.commit_rows(batch)

        writer = self.plan(spark).writeStream.queryName(self.name).foreachBatch(each)
        if self.checkpoint:
            writer = writer.option("checkpointLocation", self.checkpoint)
        seconds = self.options.get("flush_seconds")
        writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
        return writer.start()

    def run(self, spark: SparkSession, sink: Sink) -> None:
        """Runs to the end, or fails when a batch takes longer than ``feed_timeout`` seconds."""
        watch(self.start(spark, sink), self.options.get("feed_timeout", FEED_TIMEOUT))

    def stop(self, query: StreamingQuery) -> bool:
        return stop(query, self.options.get("shutdown_timeout", SHUTDOWN_TIMEOUT))


def queue_workflow(
    name: str, stages: Sequence[Any], topic: str, group: str, client: dict[str, str], checkpoint: str | None = None,
    commit: str = "auto", positions: OffsetStore | None = None, consumer: dict[str, str] | None = None, connector: str = "kafka", **options: Any,
) -> Workflow:
    """A workflow over one topic. ``client`` holds the client's options, ``consumer`` overrides the reading ones.

    It goes on from ``positions``, if it is given and knows the topic, else from the earliest offset.
    """
    if not isinstance(topic, str) or "," in topic:
        raise ValueError("a queue workflow has exactly one topic")

    def source(spark: SparkSession) -> DataFrame:
        start = {"startingOffsets": positions.starting_offsets()} if positions is not None else {}
        return read_queue(spark, [topic], connector, group=group, **{**client, **start, **(consumer or {})})

    return Workflow(name, source, stages, checkpoint, options, commit, positions)


#: Seconds for a batch, and for a graceful stop.
FEED_TIMEOUT = SHUTDOWN_TIMEOUT = 30.0


def watch(query: StreamingQuery, seconds: float, every: float = 0.2) -> None:
    """Waits for the end of a query; if for ``seconds`` no batch has been finished, it is stopped and a TimeoutError raised."""
    done, since = None, time.monotonic()
    while not query.awaitTermination(every):
        now = (query.lastProgress or {}).get("batchId"), (query.lastProgress or {}).get("timestamp")
        if now != done or not query.status["isTriggerActive"] and not query.status["isDataAvailable"] and done is not None:
            done, since = now, time.monotonic()
        if time.monotonic() - since > seconds:
            query.stop()
            raise TimeoutError(f"{query.name or query.id}: no batch was finished in {seconds} s")


def stop(query: StreamingQuery, timeout: float = SHUTDOWN_TIMEOUT) -> bool:
    """Takes what has arrived, then stops; False if that was not done within ``timeout`` seconds and it was stopped all the same.

    A sink that is in the middle of a batch on the driver cannot be interrupted; the query then ends with that batch.
    """
    if not query.isActive:
        return query.exception() is None
    failed: list[Exception] = []

    def drain() -> None:
        try:
            query.processAllAvailable()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    waiter = threading.Thread(target=drain, daemon=True)
    waiter.start()
    waiter.join(timeout)
    done = not waiter.is_alive() and not failed
    end = threading.Thread(target=query.stop, daemon=True)
    end.start()
    end.join(None if done else timeout)
    return done


def supervise(start: Callable[[], StreamingQuery], restarts: int = 1, within: float = 5.0, cooldown: float = 0.0) -> int:
    """Runs a query to its end and starts it again from its checkpoint when it fails; gives up
    after more than ``restarts`` failures within ``within`` seconds. Returns the number of restarts."""
    failures: list[float] = []
    n = 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return n
        except Exception as e:
            logging.getLogger("millrace").warning("query failed: %s", str(e).splitlines()[0])
            now = time.monotonic()
            failures = [t for t in failures if now - t < within] + [now]
            if len(failures) > restarts:
                raise
            n += 1
            time.sleep(cooldown)


def load_workflows(path: str) -> list[Workflow]:
    """Workflows of a configuration file: a Python module with a function ``workflows()``. It is read anew each time."""
    spec = importlib.util.spec_from_file_location("millrace_config", path)
    module = importlib.util.module_from_spec(spec)  # type: ignore[arg-type]
    spec.loader.exec_module(module)  # type: ignore[union-attr]
    return list(module.workflows())


def health(spark: SparkSession) -> dict[str, dict[str, Any]]:
    """State and progress of each running query."""
    out = {}
    for q in spark.streams.active:
        p = q.lastProgress or {}
        out[q.name or str(q.id)] = {
            "healthy": q.exception() is None, "batch": p.get("batchId"), "rows": p.get("numInputRows"), "rows_per_second": p.get("processedRowsPerSecond"),
            "batch_ms": (p.get("durationMs") or {}).get("triggerExecution"), "offsets": [s.get("endOffset") for s in p.get("sources", [])],
        }
    return out


def metrics_text(spark: SparkSession, positions: dict[str, OffsetStore] | None = None) -> str:
    """Progress of the running queries, and committed positions, in the text format of metric collectors."""
    lines = []
    for name, h in sorted(health(spark).items()):
        lines.append(f'millrace_healthy{{query="{name}"}} {int(h["healthy"])}')
        for key in ("batch", "rows", "batch_ms", "rows_per_second"):
            if h[key] is not None:
                lines.append(f'millrace_{key}{{query="{name}"}} {h[key]}')
    for name, store in sorted((positions or {}).items()):
        for (topic, part), n in sorted(store.positions().items()):
            lines.append(f'millrace_position{{query="{name}",topic="{topic}",partition="{part}"}} {n}')
        lines.append(f'millrace_commit_regressions{{query="{name}"}} {store.regressions}')
    return "\n".join(lines) + "\n"


def status(spark: SparkSession) -> str:
    """A page that says the engine runs, and which queries it has."""
    rows = "".join(f"<li>{html.escape(n)}: {'ok' if h['healthy'] else 'failed'}</li>" for n, h in sorted(health(spark).items()))
    return f"<html><body><h1>millrace is running</h1><ul>{rows}</ul></body></html>"


def serve(spark: SparkSession, port: int = 0, positions: dict[str, OffsetStore] | None = None) -> ThreadingHTTPServer:
    """Serves ``/healthcheck`` (JSON; 503 if a query is not healthy), ``/metrics`` and ``/`` until ``shutdown``; ``server_port`` is its port."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            state = health(spark)
            pages = {
                "/healthcheck": lambda: ("application/json", json.dumps(state)),
                "/metrics": lambda: ("text/plain; version=0.0.4", metrics_text(spark, positions)),
                "/": lambda: ("text/html", status(spark)),
            }
            page = pages.get(self.path)
            kind, body = page() if page else ("text/plain", "not found")
            good = all(h["healthy"] for h in state.values())
            self.send_response(404 if not page else 200 if good or self.path != "/healthcheck" else 503)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args: Any) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def logger(name: str, path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """Logger of one pipe, to a file of its own if wanted."""
    log = logging.getLogger(f"millrace.{name}")
    log.setLevel(level)
    if path and not any(getattr(h, "baseFilename", None) == path for h in log.handlers):
        log.addHandler(logging.FileHandler(path))
    return log
