"""Stages, substreams, chunks, reassembly, safe offsets against plain-Python step simulations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.envelope import with_envelope
from millrace.operators import audit, blocks, chunking, stateless, substreams
from millrace.operators.assemble import assemble
from millrace.plans.pipeline import Workflow, load_workflows, node, pipe, supervise
from millrace.sources.files import feed, make_source


def stream(spark, values, schema="v long"):
    return feed(spark, [(v,) if not isinstance(v, tuple) else v for v in values], schema)


def test_empty_pipe_is_an_error():
    with pytest.raises(ValueError):
        pipe()


def test_map_keeps_every_message_once(spark):
    df = pipe([stateless.map_rows(v=F.col("v") + 1)] * 7)(stream(spark, range(50)))
    assert [(r.offset, r.v) for r in df.orderBy("offset").collect()] == [(i + 1, i + 7) for i in range(50)]


def test_strict_filter_rejects_null(spark):
    df = stream(spark, [1, None, 3])
    assert stateless.filter_rows(F.col("v") > 1, strict=False)(df).count() == 1
    with pytest.raises(Exception, match="predicate is null"):
        stateless.filter_rows(F.col("v") > 1)(df).collect()


def test_unfold_keeps_order_and_drops_empty(spark):
    df = spark.createDataFrame([(1, [3, 1]), (2, []), (3, None), (4, [9])], "o long, xs array<int>")
    df = stateless.unfold(F.col("xs"), "x")(with_envelope(df, "t", F.lit(0), F.col("o")))
    twice = stateless.unfold(F.array("x", F.col("x") * 10), "y")(df)
    assert [r.y for r in twice.orderBy("offset", "ord").collect()] == [3, 30, 1, 10, 9, 90]


def test_nested_demux_and_join(spark):
    df = pipe(substreams.demux(F.col("v") % 2), substreams.demux(F.col("v") % 3))(stream(spark, range(6)))
    assert {tuple(r.route) for r in df.collect()} == {(str(i % 3), str(i % 2)) for i in range(6)}
    back = pipe(substreams.join_streams(), substreams.join_streams(), substreams.join_streams())(df)
    assert all(r.route == [] for r in back.collect())


def test_route_dependent(spark):
    df = pipe(substreams.demux(F.col("v") % 3), substreams.route_dependent({"0": {"w": F.col("v") * 100}, "1": {"w": -F.col("v")}}))(stream(spark, range(6)))
    assert {r.v: r.w for r in df.collect()} == {0: 0, 1: -1, 2: None, 3: 300, 4: -4, 5: None}


@pytest.mark.parametrize("length", [1, 2, 7])
def test_count_chunks_match_a_loop(spark, length):
    rng = random.Random(length)
    keys = [rng.choice("aab") for _ in range(60)]
    df = substreams.demux(F.col("k"))(stream(spark, [(k, i) for i, k in enumerate(keys)], "k string, v long"))
    got = chunking.chunk_by_count(length, xs=chunking.in_chunk_order("v"))(df).collect()
    want = []
    for k in set(keys):
        mine = [i for i, x in enumerate(keys) if x == k]
        want += [(k, mine[i : i + length]) for i in range(0, len(mine), length)]
    assert sorted((r.route[0], [x.v for x in r.xs]) for r in got) == sorted(want)
    assert all(r.is_open == (r.n < length) for r in got)


def test_numbering_over_many_blocks(spark):
    df = stream(spark, range(40))
    assert [r.rn for r in chunking.numbered(df, block=3).orderBy("offset").collect()] == list(range(40))


def test_chunk_lengths():
    assert chunking.chunk_length(100, True) == 101
    assert chunking.chunk_length(0, True) == 1
    assert chunking.chunk_length(0, False) == 2
    assert chunking.chunk_length(100, True, exact=True) == 100


@pytest.mark.parametrize("counts_first", [True, False])
def test_size_cut_matches_a_loop(spark, counts_first):
    rng = random.Random(5)
    sizes = [rng.randint(1, 9) for _ in range(80)]
    got = chunking.chunk_by_size("v", 20, max_messages=5, counts_first=counts_first)(stream(spark, sizes)).orderBy("chunk").collect()
    want, held, total = [], 0, 0
    for s in sizes:
        first = held == 0
        full = total + s >= 20 or held >= 5
        if first and not counts_first:
            full, s = False, 0
        held, total = held + 1, total + s
        if full:
            want.append(held)
            held, total = 0, 0
    want += [held] if held else []
    assert [r.n for r in got] == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:  # chunks that go on from batch to batch, several substreams, null parts of routes
        df = stream(spark, sizes).withColumn("route", F.when(F.col("offset") % 2 == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("route")))
        got = chunking.chunk_by_size("v", 20, max_messages=5, counts_first=counts_first)(df).collect()
        for odd in (True, False):
            mine = [s for i, s in enumerate(sizes, 1) if (i % 2 == 1) == odd]
            want, held, total = [], 0, 0
            for s in mine:
                full = (total + s >= 20 or held >= 5) and (held > 0 or counts_first)
                total += s if held or counts_first else 0
                held += 1
                if full:
                    want.append((held, total))
                    held, total = 0, 0
            want += [(held, total)] if held else []
            assert [(r.n, r.bytes) for r in sorted(got, key=lambda r: r.chunk) if (r.route == []) == odd] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_change_cut(spark):
    for block in (2, 65_536):
        df = chunking.with_previous(block, _b="v")(stream(spark, [1, 1, 2, 2, 2, 1]))
        out = chunking.chunk_by_change(F.col("_b").isNotNull() & (F.col("_b") != F.col("v")), block)(df)
        assert [(r.first_offset, r.offset) for r in out.orderBy("chunk").collect()] == [(1, 2), (3, 5), (6, 6)]


@pytest.mark.parametrize(("how", "backward", "inclusive"), [("sum", False, True), ("min", True, False), ("max", False, False), ("sum", True, False)])
def test_running_values_over_blocks(spark, how, backward, inclusive):
    rng = random.Random(how)
    rows = [(rng.choice(["a", None, "b"]), o, rng.randint(-9, 9)) for o in range(60)]
    got = blocks.running(spark.createDataFrame(rows, "k string, offset long, v long"), ["k"], ["offset"], F.col("v"), "x", how, backward=backward, inclusive=inclusive, block=7)
    for r in got.collect():
        mine = [v for k, o, v in rows if k == r.k and ((o > r.offset if backward else o < r.offset) or inclusive and o == r.offset)]
        assert r.x == ({"sum": sum, "min": min, "max": max}[how](mine) if mine else 0 if how == "sum" else None)


def test_user_aggregate(spark):
    class Sum(chunking.Aggregate):
        """Sums until 10 is reached; a negative number closes the chunk before it."""

        def __init__(self):
            self.total = None

        def add(self, offset, row):
            if row.v < 0 and self.total is not None:
                return "reject"
            self.total = (self.total or 0) + int(row.v)
            return "flush" if self.total >= 10 else "keep"

        def result(self):
            out, self.total = (self.total,), None
            return out

    out = chunking.aggregate_by(Sum, "total long")(stream(spark, [4, 7, 1, -2, 5, 20, 3])).orderBy("offset").collect()
    assert [(r.offset, r.total) for r in out] == [(2, 11), (3, 1), (6, 23), (7, 3)]


def simulate(slices):
    """One transfer after another, slice by slice."""
    out, state = [], None
    for o, (num, cnt) in enumerate(slices, 1):
        if state is None:
            state = [num == 1, 0, False, []]
        fresh, last, _, taken = state
        if fresh and num > last:
            state[2] |= num > last + 1
            state[1] = num
            taken.append(num)
        if num == cnt:
            out.append((o, not state[0], state[2], "".join(map(str, taken)) if state[0] else None))
            state = None
    return out


def check_slices(spark, slices):
    df = spark.createDataFrame([(o, "k", n, c, str(n).encode()) for o, (n, c) in enumerate(slices, 1)], "o long, key string, n int, c int, value binary")
    df = with_envelope(df, "t", F.lit(0), F.col("o"))
    got = assemble(df, F.col("n"), F.col("c"), F.col("value")).orderBy("offset").collect()
    assert [(r.offset, r.retransmission, r.corrupted, None if r.content is None else bytes(r.content).decode()) for r in got] == simulate(slices)


@pytest.mark.parametrize("nums", [[1, 2, 3, 1, 2, 3, 4, 5], [1, 2, 3, 2, 3, 4, 5], [3, 4, 5], [1, 2, 4, 5], [1, 2, 3], [1, 2, 3, 4, 5, 5], []])
def test_documented_restarts(spark, nums):
    check_slices(spark, [(n, 5) for n in nums])


def test_random_transfers(spark):
    rng = random.Random(2)
    for _ in range(4):
        check_slices(spark, [(rng.randint(1, 4), 4) for _ in range(40)])


def test_safe_offsets_match_the_definition(spark):
    rng = random.Random(9)
    df = substreams.demux(F.col("k"))(stream(spark, [(rng.choice("abcd"),) for _ in range(90)], "k string"))
    rows = audit.safe_offsets(chunking.chunk_by_count(4)(df)).collect()
    for c in rows:
        held = [b.first_offset - 1 for b in rows if b.first_offset <= c.offset and (b.is_open or b.offset > c.offset)]
        assert c.safe == (c.offset if c.is_open else min([c.offset, *held]))


def test_own_source(spark):
    spark.dataSource.register(make_source("counted", "i int", 3, lambda p, options: iter([(p * 10 + k,) for k in range(int(options["n"]))])))
    assert sorted(r.i for r in spark.read.format("counted").option("n", "2").load().collect()) == [0, 1, 10, 11, 20, 21]


def test_workflow_restarts_from_its_checkpoint(spark, tmp_path):
    from millrace.sources.files import stream_source

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    flow = Workflow("copy", lambda s: stream_source(s, str(tmp_path / "in"), "t", F.lit(0), F.col("id"), files=1), [stateless.identity()], str(tmp_path / "cp"))
    failed = []

    def sink(batch, number):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("injected")
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))

    assert supervise(lambda: flow.start(spark, sink), restarts=2) == 1
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(30))


def test_config_is_read_anew(tmp_path):
    path = tmp_path / "config.py"
    for n in (1, 2, 3):
        path.write_text(f"def workflows():\n    return ['w'] * {n}\n")
        import importlib
        import os

        os.utime(path, (n, n))
        importlib.invalidate_caches()
        assert len(load_workflows(str(path))) == n


def test_open_chunks_are_flushed_by_the_clock(spark, tmp_path):
    import time

    from millrace.sources.files import stream_source
    from millrace.streaming.chunks import chunk_stream

    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = stream_source(spark, str(tmp_path / "in"), "t", F.lit(0), F.col("id"))
    out = chunk_stream(rows, 4, "id", flush_ms=500)
    query = (
        out.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    )
    try:
        got, until = [], time.time() + 40
        while len(got) < 3 and time.time() < until:
            time.sleep(1)
            done = [str(p.parent) for p in (tmp_path / "out").glob("batch=*/_SUCCESS")]
            got = [(r.chunk, r.first_offset, r.offset, r.n) for r in spark.read.schema(out.schema).parquet(*done).collect()] if done else []
    finally:
        query.stop()
    assert sorted(got) == [(0, 0, 3, 4), (1, 4, 7, 4), (2, 8, 9, 2)]


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_upserts_run_again_with_and_without_news(spark, tmp_path):
    from millrace.streaming.chunks import upsert_stream
    from millrace.streaming.dedupe import source

    schema, root, want = "k string, v int, offset long", str(tmp_path / "root"), {}
    (tmp_path / "in").mkdir()
    rng = random.Random(3)
    for batch in range(4):
        rows = [(rng.choice(["a", "b", "c", None, "d"]), rng.randint(0, 99), batch * 100 + i) for i in range(20 if batch != 2 else 0)]
        if rows:
            land(spark, tmp_path / "in", rows, schema)
        want |= {k: v for k, v, _ in rows}
        for _ in range(2):  # the second run has nothing new
            got = upsert_stream(source(spark, str(tmp_path / "in")), ["k"], root, buckets=3)
            assert {r.k: r.v for r in got.collect()} == want
    assert len(list((tmp_path / "root/versions").glob("[0-9]*"))) <= 2
    land(spark, tmp_path / "in", [("a", -1, 5)], schema)  # an old write that comes late changes nothing
    assert {r.k: r.v for r in upsert_stream(source(spark, str(tmp_path / "in")), ["k"], root, buckets=3).collect()} == want


def test_stream_tables_run_again_and_may_be_empty(spark, tmp_path):
    from millrace.streaming.chunks import to_table
    from millrace.streaming.dedupe import source

    land(spark, tmp_path / "in", [], "id long")
    stream = lambda: source(spark, str(tmp_path / "in"))
    assert to_table(stream(), str(tmp_path / "root")).count() == 0
    land(spark, tmp_path / "in", [(1,), (2,)], "id long")
    assert to_table(stream(), str(tmp_path / "root")).count() == to_table(stream(), str(tmp_path / "root")).count() == 2


def test_routes_that_look_alike_have_states_of_their_own(spark, tmp_path):
    from millrace.sources.files import stream_source
    from millrace.streaming.chunks import chunk_stream, to_table

    routes = [["a", "b"], ["a/b"], ["a", None, "b"], [None], []]
    rng, rows = random.Random(1), []
    for i in range(90):
        rows.append((i, rng.choice(routes), float(i)))
    for part in range(3):
        land(spark, tmp_path / "in", rows[part * 30 : part * 30 + 30], "id long, r array<string>, v double")
    df = stream_source(spark, str(tmp_path / "in"), "t", F.lit(0), F.col("id"), files=1).withColumn("route", F.col("r"))
    got = {(tuple(r.route), r.chunk): (r.first_offset, r.offset, r.n, r.total) for r in to_table(chunk_stream(df, 4, "v"), str(tmp_path / "root")).collect()}
    want = {}
    for route in routes:
        mine = [i for i, r, _ in rows if r == route]
        want |= {(tuple(route), c): (x[0], x[-1], 4, float(sum(x))) for c in range(len(mine) // 4) for x in [mine[4 * c : 4 * c + 4]]}
    assert got == want and len(want) > 12


def pairs():
    class Pairs(chunking.Aggregate):
        """Pairs of numbers; refuses to let go of a single one; forgets itself after each pair; a zero rejects."""

        def __init__(self):
            self.seen = []

        def add(self, offset, row):
            if row.v == 0 and len(self.seen) == 1:
                return "reject"
            self.seen.append(row.v)
            return "flush" if len(self.seen) == 2 or row.v == 0 else "keep"

        def result(self):
            return chunking.Exit((sum(self.seen), len(self.seen))) if len(self.seen) == 2 or self.seen[-1] == 0 else None

    return Pairs


def test_user_logic_in_tables_and_streams(spark, tmp_path):
    from millrace.sources.files import stream_source
    from millrace.streaming.chunks import aggregate_stream, to_table

    rng = random.Random(12)
    rows = [(i, rng.choice("ab"), rng.choice([1, 2, 3, 4])) for i in range(40)]
    want = []
    for k in "ab":
        mine = [(i, v) for i, x, v in rows if x == k]
        want += [((k,), b[0], a[1] + b[1], 2) for a, b in zip(mine[::2], mine[1::2])]
    for part in range(4):
        land(spark, tmp_path / "in", rows[part * 10 : part * 10 + 10], "id long, k string, v long")
    table = with_envelope(spark.createDataFrame(rows, "id long, k string, v long"), "t", F.lit(0), F.col("id"))
    done = lambda df: sorted((tuple(r.route), r.offset, r.total, r.n) for r in df.collect())
    assert done(chunking.aggregate_by(pairs(), "total long, n long")(substreams.demux(F.col("k"))(table))) == sorted(want)
    stream = substreams.demux(F.col("k"))(stream_source(spark, str(tmp_path / "in"), "t", F.lit(0), F.col("id"), files=1))
    out = to_table(aggregate_stream(stream, pairs(), "total long, n long"), str(tmp_path / "root"))
    assert done(out) == sorted(want) and {r.safe for r in out.collect()} == {None}


def test_refused_and_rejected_results():
    fold = chunking.Fold(pairs())
    row = lambda v: type("Row", (), {"v": v})
    assert fold.step(1, row(5)) == [] and fold.flush() == [] and fold.held == 1 and fold.first == 1
    assert fold.step(2, row(6)) == [(2, 11, 2)] and fold.logic is None and fold.held == 0
    assert fold.step(3, row(0)) == [(3, 0, 1)]  # nothing is held, so a reject is a flush


def test_malformed_json_is_left_out(spark):
    from millrace.plans.workflows import json_upsert

    texts = ['{"foo": "a", "bar": "1"}', "{", "", None, "null", "[1]", "7", '{"foo": "a", "bar": "2"}', '{"foo": "b"}', "not json", '{"foo": "a"} x', '{"foo": "a"}] {}', '{"foo": "a"}, "w": {}', '{"foo": "a"}, {"foo": "c"}']
    df = spark.createDataFrame([(i, b"k", t.encode() if t is not None else None) for i, t in enumerate(texts)], "o long, key binary, value binary")
    got = json_upsert("foo string, bar string", ["foo"])(with_envelope(df, "t", F.lit(0), F.col("o"))).collect()
    assert {(r.foo, r.bar) for r in got} == {("a", "2"), ("b", None)}


def test_stage_forms(spark):
    df = stream(spark, [1, 2, 3, 4])
    for spec in (stateless.map_rows(w=F.col("v") * 2), ("map", {"w": F.col("v") * 2}), ("map", {"w": F.col("v") * 2}, {"partitions": 3})):
        assert sorted(r.w for r in node(spec)(df).collect()) == [2, 4, 6, 8]
    out = pipe([node(s) for s in (("demux", F.col("v") % 2), ("chunk", (2,)), "join")])(df)
    assert sorted((r.first_offset, r.offset, r.route) for r in out.collect()) == [(1, 3, []), (2, 4, [])]
    out = node(("route_dependent", {"1": stateless.map_rows(v=-F.col("v"))}))(substreams.demux(F.col("v") % 2)(df))
    assert sorted(r.v for r in out.collect()) == [-3, -1, 2, 4]
    with pytest.raises(ValueError, match="called"):
        node("nothing")
    assert [(r.offset, r.w) for r in stateless.constant(w=7)(df).orderBy("offset").collect()] == [(i, 7) for i in range(1, 5)]


def test_own_state_of_a_task_and_time_limit(spark):
    import pandas as pd

    def slow(state, f):
        import time

        state.append(len(f))
        time.sleep(0 if f["v"].max() < 9 else 5)
        return pd.DataFrame({"n": [len(state)] * len(f)})

    df = stream(spark, [1, 2, 3]).select("v").coalesce(1)
    assert [r.n for r in stateless.map_batches(list, slow, "n long", timeout=2)(df).collect()] == [1, 1, 1]
    with pytest.raises(Exception, match="longer than 0.5"):
        stateless.map_batches(list, slow, "n long", timeout=0.5)(stream(spark, [9]).select("v")).collect()


def test_safe_offsets_of_unfolded_rows(spark):
    df = with_envelope(spark.createDataFrame([(5, [1, 2, 3]), (9, [4])], "o long, xs array<int>"), "t", F.lit(0), F.col("o")).withColumn("safe", F.col("offset"))
    out = stateless.unfold(F.col("xs"), "x", safe="safe")(df).orderBy("offset", "ord").collect()
    assert [(r.x, r.safe) for r in out] == [(1, 4), (2, 4), (3, 5), (4, 9)]


def test_hidden_records_advance_only_empty_partitions(spark):
    chunks = spark.createDataFrame([("t", 0, 2, 5, False), ("t", 0, 7, 7, False), ("t", 0, 9, 9, True)], "topic string, partition int, first_offset long, offset long, is_open boolean")
    hidden = spark.createDataFrame([("t", 0, o) for o in (1, 3, 4, 6, 8, 10)] + [("t", None, 4)], "topic string, partition int, offset long")
    got = {(r.partition, r.offset) for r in audit.forwarded(hidden, chunks).collect()}
    assert got == {(0, 1), (0, 6), (0, 8), (None, 4)}


def flow_of(spark, tmp_path, **more):
    from millrace.sources.files import stream_source

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return Workflow("flow", lambda s: stream_source(s, str(tmp_path / "in"), "t", F.lit(0), F.col("id"), files=1), ["map", stateless.identity()][1:], str(tmp_path / "cp"), **more)


@pytest.mark.parametrize("commit", ["auto", "user", "never"])
def test_who_commits(spark, tmp_path, commit):
    from millrace.sinks.commit import OffsetStore

    store = OffsetStore(spark, str(tmp_path / "store"))
    flow = flow_of(spark, tmp_path, commit=commit, positions=store)
    flow.run(spark, lambda b, n: store.commit_rows(b.where("offset < 25")) if commit == "user" else None)
    assert store.positions() == {"auto": {("t", 0): 30}, "user": {("t", 0): 25}, "never": {}}[commit]


def test_a_batch_that_takes_too_long(spark, tmp_path):
    import time

    flow = flow_of(spark, tmp_path, options={"feed_timeout": 3.0})
    with pytest.raises(TimeoutError):
        flow.run(spark, lambda b, n: time.sleep(30) if n == 1 else None)
    assert not spark.streams.active


def test_graceful_stop_with_and_without_time(spark, tmp_path):
    import time

    seen = []
    flow = flow_of(spark, tmp_path, options={"flush_seconds": 1})
    assert flow.stop(flow.start(spark, lambda b, n: seen.append(b.count()))) and sum(seen) == 30
    slow = Workflow("slow", flow.source, flow.stages, str(tmp_path / "cp2"), {"flush_seconds": 1, "shutdown_timeout": 1.0})
    query = slow.start(spark, lambda b, n: time.sleep(8))
    time.sleep(2)
    t = time.time()
    assert slow.stop(query) is False and time.time() - t < 5
    query.awaitTermination(60)
    assert not query.isActive


def test_pages_of_health(spark, tmp_path):
    import json
    import urllib.error
    import urllib.request

    from millrace.plans import pipeline
    from millrace.sinks.commit import OffsetStore

    store = OffsetStore(spark, str(tmp_path / "store"))
    flow = flow_of(spark, tmp_path, positions=store, options={"flush_seconds": 1})
    query = flow.start(spark, lambda b, n: b.count())
    query.processAllAvailable()
    server = pipeline.serve(spark, positions={"flow": store})
    get = lambda page: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{page}", timeout=10).read().decode()
    try:
        assert json.loads(get("/healthcheck"))["flow"]["healthy"] is True
        text = get("/metrics")
        assert 'millrace_healthy{query="flow"} 1' in text and 'millrace_position{query="flow",topic="t",partition="0"} 30' in text and "millrace_batch_ms" in text
        assert "flow: ok" in get("/")
        with pytest.raises(urllib.error.HTTPError):
            get("/other")
    finally:
        server.shutdown()
        query.stop()


def test_log_of_a_pipe(tmp_path):
    from millrace.plans.pipeline import logger

    for _ in range(2):
        logger("p1", str(tmp_path / "p1.log")).info("said")
    assert (tmp_path / "p1.log").read_text() == "said\nsaid\n"


def test_queue_workflow_reads_one_topic_from_its_positions(spark, tmp_path):
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    from millrace.plans.pipeline import queue_workflow
    from millrace.sinks.commit import OffsetStore

    class FakeTopic(DataSource):
        @classmethod
        def name(cls):
            return "faketopic"

        def schema(self):
            return "topic string, partition int, offset long, key binary, value binary"

        def simpleStreamReader(self, schema):
            options = dict(self.options)

            class R(SimpleDataSourceStreamReader):
                def initialOffset(self):
                    import json

                    at = options["startingoffsets"] if "startingoffsets" in options else options["startingOffsets"]
                    return {"at": 0 if at == "earliest" else json.loads(at)["t"]["0"]}

                def read(self, start):
                    rows = [("t", 0, o, b"k", str(o).encode()) for o in range(start["at"], 12)]
                    return iter(rows), {"at": max(12, start["at"])}

                def readBetweenOffsets(self, start, end):
                    return iter([("t", 0, o, b"k", str(o).encode()) for o in range(start["at"], end["at"])])

            return R()

    spark.dataSource.register(FakeTopic)
    store, seen = OffsetStore(spark, str(tmp_path / "store")), []
    for run in range(2):
        flow = queue_workflow("q", [stateless.filter_rows(F.col("offset") >= 0)], "t", "g", {"kafka.bootstrap.servers": "a:1"}, str(tmp_path / f"cp{run}"), positions=store, connector="faketopic")
        flow.run(spark, lambda b, n: seen.extend(r.offset for r in b.collect() if r.offset < 8) or store.commit_rows(b.where("offset < 8")))
        if run == 0:
            assert sorted(seen) == list(range(8)) and store.positions() == {("t", 0): 12}
    assert sorted(seen) == list(range(8))
    with pytest.raises(ValueError, match="one topic"):
        queue_workflow("q", [], "a,b", "g", {})
