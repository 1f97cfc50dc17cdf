"""Sinks, record decoding and turnkey workflows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.envelope import with_envelope
from millrace.functions import records
from millrace.plans import dashboards, workflows
from millrace.sinks import files, queue, table
from millrace.sources.queue import client_options, read_options


def test_upsert_last_write_wins(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.randint(0, 99)) for i in range(50)]
    target = spark.createDataFrame([("a", -1, 0), ("z", -1, 0)], "k string, v int, offset long")
    batch = spark.createDataFrame(rows, "offset long, k string, v int")
    want = {"z": -1, **{k: v for _, k, v in rows}}
    assert {r.k: r.v for r in table.upsert(target, batch, ["k"]).collect()} == want
    again = table.upsert(table.upsert(target, batch, ["k"]), batch, ["k"])
    assert {r.k: r.v for r in again.collect()} == want


def test_map_columns_and_missing_data(spark):
    df = spark.createDataFrame([(7, "x", None)], "offset long, a string, b string")
    assert table.map_columns(df, ["aa", "_offset"], {"a": "aa"}).first().asDict() == {"aa": "x", "_offset": 7}
    with pytest.raises(Exception, match="missing data"):
        table.map_columns(df, ["b"], required=["b"]).collect()


def test_buckets_rotate(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-01",), ("2020-02-15",), ("2020-03-01",)], "d string").withColumn("ts", F.to_timestamp("d"))
    table.write_rotated(df, "ts", str(tmp_path / "t"), 10)
    gone = table.drop_expired(str(tmp_path / "t"), spark, "2020-03-03", 10, 20)
    assert len(gone) == 1
    assert {r.d for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"2020-02-15", "2020-03-01"}
    made, dropped = table.ensure_buckets(spark, str(tmp_path / "t"), "2020-03-20", 10, 20)
    assert len(made) == 4 and len(dropped) == 1
    assert len(table.ensure_buckets(spark, str(tmp_path / "t"), "2020-03-20", 10, 20)[0]) == 0
    table.write_rotated(df, "ts", str(tmp_path / "s"), 10, index=["d"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
    b = spark.range(1).select(table.planned_buckets(F.lit("2020-03-03"), 10).alias("b")).first().b
    assert len(b) == 4 and b[1] - b[0] == 10 and b[0] % 10 == 0


def test_scratch_folders_are_cleaned(spark):
    from millrace import common

    at = common.scratch(spark, "x")
    spark.range(3).write.parquet(at)
    assert common.clean(spark) >= 1 and not common.Files(spark, at).fs.exists(common.Files(spark, at)._path(at))


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from types import SimpleNamespace

    from millrace import common

    def session(master):
        none = SimpleNamespace(isDefined=lambda: False)
        sc = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda *_: None), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=sc)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="share"):
            common.shared_dir(session(master))
    assert common.shared_dir(session("local[2]"))


def test_upsert_statement():
    assert table.upsert_statement("t", ["a", "b"], ["a"]) == "INSERT INTO t (a, b) VALUES (?, ?) ON CONFLICT (a) DO UPDATE SET b = EXCLUDED.b"
    assert table.upsert_statement("t", ["a"], ["a"]).endswith("DO NOTHING")


HEAD = "num int, cnt int, del string"


def slices(rows):
    return [(o, k.encode(), v, n, c, d) for o, (k, v, n, c, d) in enumerate(rows)]


def test_objects_written_deleted_and_written_again(spark, tmp_path):
    rows = slices([("1", b"old", 1, 1, None), ("1", b"ab", 1, 3, None), ("2", b"x", 1, 1, None), ("1", b"c", 2, 3, None), ("1", b"c", 2, 3, None), ("2", b"", 1, 1, "1"), ("1", b"d", 3, 3, None), ("3", b"z", 2, 2, None), ("4", b"half", 1, 2, None)])
    df = with_envelope(spark.createDataFrame(rows, f"o long, key binary, value binary, {HEAD}"), "t", F.lit(0), F.col("o"))
    at = str(tmp_path / "o")
    for _ in range(2):
        done = files.write_slices(df, at, F.col("num"), F.col("cnt"), F.col("value"), F.col("del")).collect()
        assert {(r.path[-1], r.deleted, r.n_bytes) for r in done} == {("1", False, 4), ("2", True, 0)}
    assert (tmp_path / "o/1").read_bytes() == b"abcd"
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["1"]


def test_large_objects_go_in_parts(spark, tmp_path):
    """Three objects of 9 MB in slices of 1 MB with repeats, parts of 2 MB."""
    from millrace.functions import payload

    n, size = 9, 1 << 20
    base = spark.range(3 * n).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") / 3).cast("int").alias("i"))
    base = base.select("k", (F.col("i") + 1).alias("num"), payload.stream_slice(F.col("k"), F.col("i") * size, F.lit(size)).alias("value"))
    df = payload.with_repeats(base.withColumn("o", F.col("num") * 3 + F.col("k").cast("int")), "o", 3)
    df = with_envelope(df.withColumn("key", F.col("k").cast("binary")), "t", F.lit(0), F.col("o"))
    done = files.write_slices(df, str(tmp_path), F.col("num"), F.lit(n), F.col("value"), part_bytes=2 << 20).collect()
    assert {(r.n_bytes, r.n_parts) for r in done} == {(n * size, 5)} and len(done) == 3
    for k in "012":
        assert (tmp_path / k).read_bytes() == payload.stream_bytes(k, 0, n * size)


def test_an_upload_that_breaks_off_is_aborted(spark, tmp_path):
    log = str(tmp_path / "log")

    def broken():
        class Up:
            def part(self, data):
                raise OSError("full")

            def abort(self):
                open(log, "a").write("aborted")

        class To:
            def begin(self, path):
                return Up()

        return To()

    df = with_envelope(spark.createDataFrame(slices([("1", b"x" * 100, 1, 1, None)]), f"o long, key binary, value binary, {HEAD}"), "t", F.lit(0), F.col("o"))
    with pytest.raises(Exception, match="full"):
        files.write_slices(df, "/x", F.col("num"), F.col("cnt"), F.col("value"), store=broken, part_bytes=10).collect()
    assert open(log).read().startswith("aborted")


def test_rows_upserted_and_inserted_in_a_database(spark, tmp_path):
    import sqlite3

    at = str(tmp_path / "db")
    base = sqlite3.connect(at)
    base.execute("CREATE TABLE t (name TEXT PRIMARY KEY, v INTEGER, at INTEGER)")
    base.execute("CREATE TABLE log (name TEXT, _offset INTEGER, CHECK (_offset < 900))")
    base.commit()

    def connect():
        import sqlite3

        return sqlite3.connect(at, timeout=60)

    rng = random.Random(2)
    rows = [(i, rng.choice("abcdé"), rng.randint(0, 99)) for i in range(60)]
    df = spark.createDataFrame(rows, "offset long, k string, v int").withColumn("ord", F.array().cast("array<int>"))
    for part in (df.where("offset < 30"), df.where("offset >= 30"), df.where("offset >= 30")):
        done = table.write_rows(part.withColumn("at", F.col("offset")), connect, "t", ["name", "v", "at"], ["name"], {"k": "name"}).collect()
        assert sum(r.n_rows for r in done) == part.select("k").distinct().count()
    assert dict(base.execute("SELECT name, v FROM t")) == {k: v for _, k, v in rows}
    assert sum(r.n_rows for r in table.write_rows(df, connect, "log", ["name", "_offset"], mapping={"k": "name"}).collect()) == 60
    assert sorted(base.execute("SELECT _offset, name FROM log")) == [(o, k) for o, k, _ in rows]
    with pytest.raises(Exception, match="CHECK"):
        table.write_rows(spark.createDataFrame([(901, "a")], "offset long, k string"), connect, "log", ["name", "_offset"], mapping={"k": "name"}).collect()


def test_produce_and_read_back(spark, tmp_path):
    q = queue.FileQueue(spark, str(tmp_path / "q"))
    assert q.read("t").count() == 0
    df = lambda a, b: spark.createDataFrame([(o, o % 3, str(o).encode(), [("h", b"1")]) for o in range(a, b)], "offset long, partition int, value binary, headers array<struct<key:string,value:binary>>")
    for number, rows in ((0, df(0, 20)), (1, df(20, 31)), (1, df(20, 31)), (2, df(31, 31))):
        q.produce(rows, "t", number)
    got = {(r.partition, r.offset): int(bytes(r.value)) for r in q.read("t").collect()}
    assert got == {(o % 3, o // 3): o for o in range(31)}
    assert {r.headers[0].key for r in q.read("t").collect()} == {"h"}
    assert q.heads("t")[1] == {"0": 11, "1": 10, "2": 10}


def test_produce_through_a_connector(spark, tmp_path):
    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    at = str(tmp_path / "sent")

    class FakeQueue(DataSource):
        @classmethod
        def name(cls):
            return "fakequeue"

        def schema(self):
            return "key binary, value binary, partition int"

        def writer(self, schema, overwrite):
            options = dict(self.options)

            class W(DataSourceWriter):
                def write(self, rows):
                    import uuid

                    with open(f"{options['kafka.path']}-{uuid.uuid4().hex}", "w") as f:
                        for r in rows:
                            f.write(f"{options['topic']} {options['kafka.acks']} {r.partition} {bytes(r.key).decode()} {bytes(r.value).decode()}\n")
                    return WriterCommitMessage()

            return W()

    spark.dataSource.register(FakeQueue)
    df = spark.createDataFrame([(o, str(o % 2).encode(), b"v%d" % o) for o in range(6)], "offset long, key binary, value binary")
    queue.queue_sink("out", F.col("offset") % 2, "fakequeue", **{"kafka.path": at})(df, 0)
    lines = sorted(x for p in tmp_path.glob("sent-*") for x in p.read_text().splitlines())
    assert lines == [f"out all {o % 2} {o % 2} v{o}" for o in (0, 2, 4, 1, 3, 5)]


def test_positions_only_grow(spark, tmp_path):
    from millrace.sinks.commit import OffsetStore

    store = OffsetStore(spark, str(tmp_path / "c"))
    assert store.starting_offsets() == "earliest"
    at = lambda *rows: spark.createDataFrame(list(rows), "topic string, partition int, committed long")
    store.commit(at(("t", 0, 4), ("t", 1, 9)))
    store.commit(at(("t", 0, 7), ("t", 1, 3), ("u", 0, None)))
    assert store.positions() == {("t", 0): 8, ("t", 1): 10} and store.regressions == 1
    assert OffsetStore(spark, str(tmp_path / "c")).starting_offsets() == '{"t": {"0": 8, "1": 10}}'
    assert [tuple(r) for r in store.table().orderBy("partition").collect()] == [("t", 0, 8), ("t", 1, 10)]


def test_retry_and_execute():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert files.retry(flaky, 3, 1) == "ok"
    lines = []
    assert files.execute("sh", ["-c", "echo hi; exit 3"], lines.append) == 3 and lines == ["hi"]


def test_records_survive_encoding_and_bad_ones_are_dropped(spark):
    df = spark.createDataFrame([("n", "2020-01-01 00:00:00.000001", "app" * 40, "memory", "1.5")], "node string, ts string, application string, unit string, value string")
    good = df.select(records.encode_record("app_top", df).alias("value"))
    bad = [('["unknown","x"]',), ('["app_top","x"]',), ("{",), (None,), ("",), ('["app_top","n","no time","a","memory","1"]',), ('["app_top","n","2020-01-01 00:00:00","a","memory","much"]',)]
    bad = spark.createDataFrame(bad, "value string")
    out = workflows.sysmon(good.unionByName(bad))
    r = out["app_top"].collect()
    assert len(r) == 1 and len(r[0].application) == 60 and r[0].ts.microsecond == 1
    assert out["prc"].count() == 0


def test_format_function(spark):
    df = spark.createDataFrame([("m" * 40, "f", 2), (None, "f", 1)], "m string, f string, a int")
    assert [r[0] for r in df.select(records.format_function(F.col("m"), F.col("f"), F.col("a"))).collect()] == ["m" * 30 + ":f/2", "no data"]


def test_retransmit_loses_nothing_and_keeps_keys_together(spark):
    df = spark.createDataFrame([(i, str(i % 13).encode(), str(i).encode(), []) for i in range(200)], "o long, key binary, value binary, headers array<struct<key:string,value:binary>>")
    out = workflows.retransmit(5)(with_envelope(df, "t", F.lit(0), F.col("o"))).collect()
    assert sorted(int(bytes(r.value)) for r in out) == list(range(200))
    assert all(len({r.partition for r in out if bytes(r.key) == k}) == 1 for k in {bytes(r.key) for r in out})


def test_queue_options(tmp_path):
    o = client_options({"main": {"endpoints": "a:1", "timeout_ms": 5}}, "main", {"timeout_ms": 60, "protocol": "SSL"})
    rest = {"kafka.compression.type": "gzip", "kafka.allow.auto.create.topics": "false"}
    assert o == {"kafka.bootstrap.servers": "a:1", "kafka.request.timeout.ms": "5", "kafka.security.protocol": "SSL", **rest}
    (tmp_path / "login").write_text('me\np"w\n')
    o = client_options({"a": {"endpoints": "b:2", "ssl": True, "compression": "none"}, "b": {"ssl": False}}, "a", {"sasl_file": str(tmp_path / "login")})
    assert (o["kafka.security.protocol"], o["kafka.sasl.mechanism"], o["kafka.compression.type"]) == ("SASL_SSL", "PLAIN", "none")
    assert o["kafka.sasl.jaas.config"].endswith('username="me" password="p\\"w";')
    assert client_options({"b": {"ssl": False}}, "b")["kafka.security.protocol"] == "PLAINTEXT"
    assert read_options(["t"])["startingOffsets"] == "earliest"
    assert queue.produce_options("t")["kafka.acks"] == "all"


def test_all_queries_against_their_sql(spark, sf):
    """Every registered query of the rest of the library runs over the smallest tables and gives what its SQL gives."""
    import decimal
    import glob
    import os

    import __spark_entry__ as entry
    duckdb = pytest.importorskip("duckdb")

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")

    def plain(v):
        if isinstance(v, (float, decimal.Decimal)) or isinstance(v, int) and not isinstance(v, bool):
            return "nan" if v != v else float(f"{float(v):.9g}")
        return bytes(v) if isinstance(v, bytearray) else tuple(map(plain, v)) if isinstance(v, list) else v

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    own = [k for k in q if q[k].__module__.startswith("millrace.queries")]
    for name in own:
        df = q[name](spark, sf)
        columns = sorted(df.columns)
        assert len(set(columns)) == len(columns), name
        got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
        if name in sql:
            rows = con.execute(sql[name])
            at = {c[0]: i for i, c in enumerate(rows.description)}
            assert sorted(at) == columns, name
            assert got == sorted((tuple(plain(r[at[c]]) for c in columns) for r in rows.fetchall()), key=repr), name
    assert entry.entry(spark).count() > 0


def test_dashboards_over_all_days(spark, tmp_path):
    import __spark_entry__ as entry

    t0 = dt.datetime(2020, 1, 1, 0, 0, 0, 500_000)
    at = [t0 + dt.timedelta(hours=i) for i in range(72)]
    app = [("n", t, a, u, i) for i, t in enumerate(at) for a in "xy" for u in ("memory", "processes", "reductions")] + [("n", None, "x", "memory", 5)]
    fun = [("n", t, "f", k, i) for i, t in enumerate(at) for k in ("initial_call", "current_function")] + [("n", None, "f", "initial_call", 5)]
    prc = [("n", t, "<0.116.0>", None, "m:f/0", i) for i, t in enumerate(at)] + [("n", None, "<0.116.0>", None, "m:f/0", 5)]
    spark.createDataFrame(app, "node string, ts timestamp_ntz, application string, unit string, value long").write.parquet(str(tmp_path / "app_top.parquet"))
    spark.createDataFrame(fun, "node string, ts timestamp_ntz, fun string, fun_type string, num_processes long").write.parquet(str(tmp_path / "fun_top.parquet"))
    schema = "node string, ts timestamp_ntz, pid string, registered_name string, current_function string, memory long"
    full = spark.createDataFrame(prc, schema).withColumns({"reductions": F.lit(1), "message_queue_len": F.lit(0), "dreductions": F.lit(1.0), "dmemory": F.lit(1.0), "current_stacktrace": F.lit("s")})
    full.write.parquet(str(tmp_path / "prc.parquet"))
    q = {k: entry.queries()[f"dash_{k}"](spark, str(tmp_path)).collect() for k in ("log_avg", "avg_memory", "avg_processes", "avg_initial_call", "avg_current_function", "history", "not_similar")}
    start, width = t0.replace(tzinfo=dt.UTC).timestamp(), (71 * 3600 + 1) // 100
    buckets = [int((start + 3600 * i) / width + 0.5) * width for i in range(72)]
    for name in ("avg_memory", "avg_processes", "avg_initial_call", "avg_current_function"):
        keys = ["f"] if "_c" in name else ["x", "y"]
        assert sorted(map(tuple, q[name])) == sorted(("n", k, b, float(i)) for k in keys for i, b in enumerate(buckets))
    assert sorted(r.bucket for r in q["log_avg"]) == sorted(buckets * 2)
    assert [r.ts for r in q["history"]] == at
    assert [(r.node, r.ts, r.current_function) for r in q["not_similar"]] == [("n", t, "m:f/0") for t in at]
    view = {"node": "n", "start": at[10], "end": at[20]}
    got = dashboards.averages(spark.read.parquet(str(tmp_path / "app_top.parquet")), "application", "value", F.col("unit") == "memory", **view).where("application = 'x'")
    assert sorted((r.bucket, r.mean) for r in got.collect()) == [(int((start + 3600 * i) / 360 + 0.5) * 360, float(i)) for i in range(10, 21)]
    p = spark.read.parquet(str(tmp_path / "prc.parquet"))
    assert [r.ts for r in dashboards.history(p, ["memory"], pid="<0.116.0>", not_in="m:", **view).collect()] == []
    assert [r.ts for r in dashboards.history(p, ["memory"], pid="<0.116.0>", name="x", **view).collect()] == at[10:21]
    role = spark.createDataFrame([("n", at[15], 1, "a"), ("n", at[30], 2, "b"), ("m", at[15], 3, "c")], "node string, ts timestamp_ntz, offset long, data string")
    assert [r.data for r in dashboards.latest_status(role, "n", at[16]).collect()] == ["b"]
    assert [r.ts for r in dashboards.snapshot(p.withColumns({c: F.lit(0) for c in dashboards.PROCESS if c not in p.columns}), role, "n", at[1], at[20]).collect()] == [at[15]]
