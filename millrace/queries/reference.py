"""Queries of the pipeline operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.common import cut, load, scratch
from millrace.envelope import with_envelope
from millrace.functions import payload
from millrace.functions import records as rec
from millrace.operators import audit, chunking, stateless, substreams
from millrace.operators.assemble import Assembler, assemble, assemble_by, header
from millrace.plans import dashboards as dash
from millrace.plans import workflows
from millrace.plans.pipeline import pipe
from millrace.queries import Registry
from millrace.sinks import table as tables
from millrace.sinks.commit import OffsetStore
from millrace.sinks.queue import FileQueue, hash_partition
from millrace.streaming import chunks as stream_chunks
from millrace.streaming.dedupe import source

R = Registry()
FULL = chunking.chunk_length(100, counts_first=True)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return with_envelope(load(spark, d, "events"), "events", F.col("user_id") % 5, F.col("event_id"))


def _messages(spark: SparkSession, d: str, topic: str) -> DataFrame:
    m = load(spark, d, "messages").where(F.col("topic") == topic)
    return with_envelope(m, F.col("topic"), F.col("partition"), F.col("offset"))


# stateless stages
def map_project(spark: SparkSession, d: str) -> DataFrame:
    stage = stateless.map_rows(doubled=F.col("value") * 2, tag=F.concat_ws("-", "event_type", F.col("offset").cast("string")))
    return stage(_events(spark, d)).select("partition", "offset", "doubled", "tag")


def filter_predicate(spark: SparkSession, d: str) -> DataFrame:
    stage = stateless.filter_rows((F.col("value") > 50) & (F.col("offset") % 2 == 0))
    return stage(_events(spark, d)).select("partition", "offset", "event_type", "value")


def mfd_route(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    stage = stateless.map_filter_route(kind != "error", F.when(kind.isin("click", "view"), kind), amount=F.col("value") + 1)
    out = stage(_events(spark, d))
    return out.select("offset", "partition", F.array_join("route", "/").alias("route"), "amount")


def unfold_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = with_envelope(load(spark, d, "documents").select("doc_id", "text"), "documents", F.lit(0), F.col("doc_id"))
    out = stateless.unfold(F.split("text", "\n"), "line")(docs)
    return out.select("doc_id", F.element_at("ord", -1).cast("long").alias("pos"), F.length("line").cast("long").alias("n_chars"))


EVENTS_SQL = "SELECT 'events' AS topic, (user_id % 5)::int AS \"partition\", event_id AS \"offset\", * FROM events"
R.add("map_project", map_project, f"""SELECT "partition", "offset", value * 2 AS doubled, event_type || '-' || "offset"::varchar AS tag FROM ({EVENTS_SQL})""")
R.add("filter_predicate", filter_predicate, f"""SELECT "partition", "offset", event_type, value FROM ({EVENTS_SQL}) WHERE value > 50 AND "offset" % 2 = 0""")
R.add("mfd_route", mfd_route, f"""SELECT "offset", "partition", CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '' END AS route, value + 1 AS amount
FROM ({EVENTS_SQL}) WHERE event_type <> 'error'""")
R.add("unfold_lines", unfold_lines, """SELECT doc_id, i - 1 AS pos, length(s[i])::bigint AS n_chars
FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))""")


# substreams
def demux_route_counts(spark: SparkSession, d: str) -> DataFrame:
    out = substreams.demux(F.col("event_type"))(_events(spark, d))
    return out.groupBy("partition", substreams.route_head().alias("route_head")).agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"))


def demux_nested(spark: SparkSession, d: str) -> DataFrame:
    out = pipe(substreams.demux(F.col("event_type")), substreams.demux(F.col("user_id") % 3))(_events(spark, d))
    return out.groupBy(F.array_join("route", "/").alias("route")).agg(F.count("*").alias("n"))


def join_merge_order(spark: SparkSession, d: str) -> DataFrame:
    stages = pipe(substreams.demux(F.col("event_type")), chunking.chunk_by_count(FULL), substreams.join_streams())
    return stages(_events(spark, d)).select("partition", "offset", "n", F.size("route").alias("depth")).orderBy("partition", "offset")


def route_dependent_case(spark: SparkSession, d: str) -> DataFrame:
    stage = substreams.route_dependent({"click": {"amount": F.col("value") * 10}, "error": {"amount": F.lit(-1.0)}}, {"amount": F.col("value")})
    return pipe(substreams.demux(F.col("event_type")), stage)(_events(spark, d)).select("offset", substreams.route_head().alias("route_head"), "amount")


_COUNT_SQL = """WITH e AS ({events}),
r AS (SELECT *, (row_number() OVER (PARTITION BY "partition", event_type ORDER BY "offset") - 1) // {k} AS chunk FROM e),
c AS (SELECT "partition", event_type, chunk, min("offset") AS first_offset, max("offset") AS "offset", count(*) AS n, sum(user_id)::bigint AS total FROM r GROUP BY ALL)
"""
COUNT_SQL = _COUNT_SQL.format(events=EVENTS_SQL, k=FULL)
R.add("demux_route_counts", demux_route_counts, f'SELECT "partition", event_type AS route_head, count(*) AS n, max("offset") AS last_offset FROM ({EVENTS_SQL}) GROUP BY ALL')
R.add("demux_nested", demux_nested, f"SELECT (user_id % 3)::varchar || '/' || event_type AS route, count(*) AS n FROM ({EVENTS_SQL}) GROUP BY ALL")
R.add("join_merge_order", join_merge_order, COUNT_SQL + 'SELECT "partition", "offset", n, 0 AS depth FROM c')
R.add("route_dependent_case", route_dependent_case, f"""SELECT "offset", event_type AS route_head,
CASE event_type WHEN 'click' THEN value * 10 WHEN 'error' THEN -1.0 ELSE value END AS amount FROM ({EVENTS_SQL})""")


# chunks
def _chunks(spark: SparkSession, d: str, length: int) -> DataFrame:
    stage = chunking.chunk_by_count(length, total=F.sum("user_id"))
    return pipe(substreams.demux(F.col("event_type")), stage)(_events(spark, d))


def chunk_group_messages(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, FULL).select("partition", substreams.route_head().alias("route_head"), "chunk", "first_offset", "offset", "n", "total", "is_open")


def chunk_buffer(spark: SparkSession, d: str) -> DataFrame:
    """A buffer of one message still holds two."""
    small = _chunks(spark, d, chunking.chunk_length(0, counts_first=False))
    return small.select("partition", substreams.route_head().alias("route_head"), "chunk", "first_offset", "offset", "n", "total", "is_open")


def chunk_size_cut(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d, "kf.numbers").withColumn("size", F.octet_length("value"))
    return chunking.chunk_by_size("size", 4096)(m).select("partition", "chunk", "first_offset", "offset", "n", "bytes", "is_open")


def chunk_change_islands(spark: SparkSession, d: str) -> DataFrame:
    df = pipe(substreams.demux(F.col("user_id")), chunking.with_previous(_before="event_type"))(_events(spark, d))
    broken = F.col("_before").isNotNull() & (F.col("_before") != F.col("event_type"))
    out = chunking.chunk_by_change(broken, kind=F.min("event_type"))(df)
    return out.select(substreams.route_head().cast("long").alias("user_id"), "chunk", "first_offset", "offset", "n", "kind")


def chunk_then_chunk(spark: SparkSession, d: str) -> DataFrame:
    stages = pipe(
        substreams.demux(F.col("event_type")), chunking.chunk_by_count(FULL), substreams.join_streams(),
        chunking.chunk_by_count(3, rows=F.sum("n")),
    )
    return stages(_events(spark, d).select("topic", "partition", "offset", "ord", "route", "event_type")).select("partition", "chunk", "first_offset", "offset", "n", "rows")


_CHUNK_OUT = 'SELECT "partition", event_type AS route_head, chunk, first_offset, "offset", n, total, n < {k} AS is_open FROM c'
R.add("chunk_group_messages", chunk_group_messages, COUNT_SQL + _CHUNK_OUT.format(k=FULL))
R.add("chunk_buffer", chunk_buffer, _COUNT_SQL.format(events=EVENTS_SQL, k=2) + _CHUNK_OUT.format(k=2))
R.add("chunk_size_cut", chunk_size_cut, """WITH RECURSIVE e AS (SELECT "partition", "offset", coalesce(octet_length(value), 0)::bigint AS size,
  row_number() OVER (PARTITION BY "partition" ORDER BY "offset") AS i FROM messages WHERE topic = 'kf.numbers'),
s AS (SELECT "partition", i, "offset", 0::bigint AS chunk, size AS held, size >= 4096 AS done FROM e WHERE i = 1
  UNION ALL SELECT e."partition", e.i, e."offset", s.chunk + s.done::int, CASE WHEN s.done THEN e.size ELSE s.held + e.size END, CASE WHEN s.done THEN e.size ELSE s.held + e.size END >= 4096
  FROM s JOIN e ON e."partition" = s."partition" AND e.i = s.i + 1)
SELECT "partition", chunk, min("offset") AS first_offset, max("offset") AS "offset", count(*) AS n, max(held) AS bytes, NOT bool_or(done) AS is_open FROM s GROUP BY "partition", chunk""")
R.add("chunk_change_islands", chunk_change_islands, f"""WITH e AS ({EVENTS_SQL}),
b AS (SELECT *, CASE WHEN lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS brk FROM e WINDOW w AS (PARTITION BY "partition", user_id ORDER BY "offset")),
i AS (SELECT *, sum(brk) OVER (PARTITION BY "partition", user_id ORDER BY "offset") AS chunk FROM b)
SELECT user_id, chunk::bigint AS chunk, min("offset") AS first_offset, max("offset") AS "offset", count(*) AS n, min(event_type) AS kind FROM i GROUP BY user_id, "partition", chunk""")
R.add("chunk_then_chunk", chunk_then_chunk, COUNT_SQL + """,
q AS (SELECT *, (row_number() OVER (PARTITION BY "partition" ORDER BY "offset") - 1) // 3 AS k FROM c)
SELECT "partition", k AS chunk, min("offset") AS first_offset, max("offset") AS "offset", count(*) AS n, sum(n)::bigint AS "rows" FROM q GROUP BY "partition", k""")


# reassembly
def _objects(spark: SparkSession, d: str) -> DataFrame:
    return assemble(_messages(spark, d, "kf.objects"), header("slice_num"), header("slice_cnt"), F.col("value"), header("deleted"))


def assemble_objects(spark: SparkSession, d: str) -> DataFrame:
    return _objects(spark, d).select(
        "partition", F.col("key").cast("string").alias("key"), "offset", "retransmission", "corrupted", "deleted", "n_slices",
        F.md5(F.hex("content")).alias("content_md5"),
    )


def sink_files_manifest(spark: SparkSession, d: str) -> DataFrame:
    return workflows.chunks_to_files("/objects")(_messages(spark, d, "kf.objects")).select("path", "offset", "deleted", "retransmission", F.col("n_bytes").cast("long").alias("n_bytes"))


OBJECTS_SQL = """WITH o AS (
  SELECT "partition", "key", "offset", value, batch_id, received_at,
    decode([h.value FOR h IN headers IF h.key = 'slice_num'][1])::int AS num, decode([h.value FOR h IN headers IF h.key = 'slice_cnt'][1])::int AS cnt,
    coalesce(decode([h.value FOR h IN headers IF h.key = 'deleted'][1]), '0') = '1' AS del
  FROM messages WHERE topic = 'kf.objects'),
e AS (SELECT *, coalesce(sum(CASE WHEN num = cnt THEN 1 ELSE 0 END) OVER (PARTITION BY "partition", "key" ORDER BY "offset", received_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tr FROM o),
t AS (SELECT *, coalesce(max(num) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top, first(num) OVER w = 1 AS fresh FROM e
  WINDOW w AS (PARTITION BY "partition", "key", tr ORDER BY "offset", received_at)),
a AS (SELECT "partition", "key", tr, max("offset") AS "offset", NOT bool_or(fresh) AS retransmission, bool_or(fresh AND num > top + 1) AS corrupted,
    bool_or(del AND num = 1) AS deleted, (count(*) FILTER (WHERE fresh AND num > top))::int AS n_slices,
    string_agg(hex(coalesce(value, ''::blob)), '' ORDER BY "offset") FILTER (WHERE fresh AND num > top) AS content
  FROM t GROUP BY "partition", "key", tr HAVING bool_or(num = cnt))
"""
R.add("assemble_objects", assemble_objects, OBJECTS_SQL + 'SELECT "partition", decode("key") AS "key", "offset", retransmission, corrupted, deleted, n_slices, md5(content) AS content_md5 FROM a')
R.add("sink_files_manifest", sink_files_manifest, OBJECTS_SQL + """SELECT '/objects/' || decode("key") AS path, "offset", deleted, retransmission,
CASE WHEN NOT retransmission AND NOT deleted THEN (length(content) // 2)::bigint END AS n_bytes FROM a""")


# tables
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return workflows.json_upsert("foo string, bar string", ["partition", "foo"])(_messages(spark, d, "kf.upserts")).select("partition", "foo", "bar", "offset")


def insert_mapped(spark: SparkSession, d: str) -> DataFrame:
    return tables.map_columns(load(spark, d, "fun_top"), ["node", "time", "fun", "_offset"], {"ts": "time"}, required=["fun"])


TODAY = "1997-06-15"


def partition_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = tables.bucket(F.col("o_orderdate"), 10)
    g = load(spark, d, "orders").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    return g.select("bucket", tables.bucket_date(F.col("bucket")).cast("string").alias("first_day"), "n")


def partition_retention(spark: SparkSession, d: str) -> DataFrame:
    today = F.lit(TODAY)
    need = spark.range(1).select(F.explode(tables.planned_buckets(today, 10)).alias("bucket"), F.lit("create").alias("action"))
    old = load(spark, d, "orders").select(tables.bucket(F.col("o_orderdate"), 10).alias("bucket")).distinct()
    return need.unionByName(old.where(tables.expired(F.col("bucket"), today, 10, 30)).withColumn("action", F.lit("drop")))


def retransmit_partition(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d, "kf.numbers")
    out = workflows.retransmit(5, partition=F.coalesce(F.col("key").cast("string").try_cast("long") % 5, F.lit(0)))(m)
    return out.groupBy("partition").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"))


R.add("upsert_latest", upsert_latest, """WITH j AS (SELECT "partition", "offset", decode(value) AS v FROM messages WHERE topic = 'kf.upserts' AND value IS NOT NULL),
f AS (SELECT "partition", "offset", json_extract_string(v, '$.foo') AS foo, json_extract_string(v, '$.bar') AS bar FROM j WHERE json_valid(v))
SELECT "partition", foo, max_by(bar, "offset") AS bar, max("offset") AS "offset" FROM f GROUP BY "partition", foo""")
R.add("insert_mapped", insert_mapped, 'SELECT node, ts AS "time", fun, "offset" AS _offset FROM fun_top')
_BUCKET_SQL = "(719528 + datediff('day', DATE '1970-01-01', o_orderdate::date)) // 10 * 10"
R.add("partition_buckets", partition_buckets, f"""SELECT b::int AS bucket, strftime(DATE '1970-01-01' + (b - 719528)::int, '%Y-%m-%d') AS first_day, count(*) AS n
FROM (SELECT {_BUCKET_SQL} AS b FROM orders) GROUP BY b""")
R.add("partition_retention", partition_retention, f"""WITH t AS (SELECT (719528 + datediff('day', DATE '1970-01-01', DATE '{TODAY}')) // 10 * 10 AS b)
SELECT (b + 10 * i)::int AS bucket, 'create' AS action FROM t, range(0, 4) r(i)
UNION ALL SELECT DISTINCT b2::int, 'drop' FROM (SELECT {_BUCKET_SQL} AS b2 FROM orders), t WHERE b2 < b - 30""")
R.add("retransmit_partition", retransmit_partition, """SELECT coalesce(try_cast(decode("key") AS bigint) % 5, 0)::int AS "partition", count(*) AS n, sum(octet_length(value))::bigint AS bytes
FROM messages WHERE topic = 'kf.numbers' GROUP BY 1""")


# monitoring records
def _encoded(spark: SparkSession, d: str, tag: str) -> DataFrame:
    """The records of a table as they come over the queue, each second one followed by one that cannot be read:
    an unknown tag, a field too many, a time that is none, half of the text, or no JSON."""
    df = load(spark, d, rec.RECORDS[tag][0])
    good = df.select("partition", "offset", rec.encode_record(tag, df).alias("value"))
    text, at = F.col("value"), F.array_position(F.array(*[F.lit(f) for f, _ in rec.fields_of(tag)]), "ts")
    bad_time = F.to_json(F.transform(F.from_json(text, "array<string>"), lambda x, i: F.when(i == at, F.lit("not a time")).otherwise(x)))
    bad = F.element_at(F.array(
        F.regexp_replace(text, f'^\\["{tag}"', '["other"'), F.regexp_replace(text, r"\]$", ',"more"]'), bad_time,
        F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")), F.lit("<" + tag + ">"),
    ), (F.pmod("offset", F.lit(5)) + 1).cast("int"))
    return good.unionByName(good.where("offset % 2 = 0").withColumn("value", bad))


def _ingest(tag: str):  # noqa: ANN202
    name = rec.RECORDS[tag][0]

    def query(spark: SparkSession, d: str) -> DataFrame:
        return workflows.sysmon(_encoded(spark, d, tag))[name].select("partition", "offset", *[f for f, _ in rec.fields_of(tag)])

    columns = ", ".join(f for f, _ in rec.fields_of(tag))
    R.add(f"sysmon_ingest_{name}", query, f'SELECT "partition", "offset", {columns} FROM {name}')


for _tag in ("erl_top", "app_top", "fun_top", "node_role"):
    _ingest(_tag)

def sysmon_received(spark: SparkSession, d: str) -> DataFrame:
    """All kinds at once through the whole receiver, as two batches of which the second comes twice."""
    root, out = scratch(spark, "receiver"), None
    for tag in ("erl_top", "app_top", "fun_top", "node_role"):
        one = _encoded(spark, d, tag).withColumn("topic", F.lit("records"))
        out = one if out is None else out.unionByName(one)
    sink = workflows.sysmon_sink(spark, root, retention_days=20)
    for number, rows in ((0, out.where("offset % 3 = 0")), (1, out.where("offset % 3 <> 0")), (1, out.where("offset % 3 <> 0"))):
        sink(rows, number)
    counts = None
    for name in ("prc", "app_top", "fun_top", "node_role"):
        t = workflows.sysmon_table(spark, root, name)
        one = t.groupBy(F.lit(name).alias("tbl"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("partition", "offset").alias("n_offsets"), F.count("node").alias("n_nodes"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


_ONE_KIND = """SELECT '{t}' AS tbl, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT ("partition", "offset")) AS n_offsets, count(node) AS n_nodes
FROM {t}, (SELECT max(ts)::date AS top FROM {t}) WHERE datediff('day', ts::date, top) <= 20 GROUP BY ALL"""
R.add("sysmon_received", sysmon_received, " UNION ALL ".join(_ONE_KIND.format(t=t) for t in ("prc", "app_top", "fun_top", "node_role")))

# dashboards: every node, all of the table, a hundredth of its range for a bucket
_CHARTS = {
    "log_avg": ("app_top", "application", "value", "unit = 'reductions'"),
    "avg_memory": ("app_top", "application", "value", "unit = 'memory'"),
    "avg_processes": ("app_top", "application", "value", "unit = 'processes'"),
    "avg_initial_call": ("fun_top", "fun", "num_processes", "fun_type = 'initial_call'"),
    "avg_current_function": ("fun_top", "fun", "num_processes", "fun_type = 'current_function'"),
}


def _chart_sql(table: str, key: str, value: str, where: str, log: bool, more: str = "", width: str = "") -> str:
    mean = f"sum({value})::double / count({value})"
    width = width or f"(SELECT greatest((ceil(epoch_us(max(ts)) / 1e6)::bigint - floor(epoch_us(min(ts)) / 1e6)::bigint) // 100, 1) AS tp FROM {table})"
    sql = f"""SELECT node, {key}, (round(epoch_us(ts) / 1e6 / tp) * tp)::bigint AS bucket, {mean} AS mean
FROM {table}, {width} WHERE ts IS NOT NULL AND {where} {more} GROUP BY ALL"""
    return f"SELECT node, {key}, bucket, round(CASE WHEN mean > 0 THEN log10(mean) END, 9) AS log_mean FROM ({sql})" if log else sql


#: A viewer's node and range: the busiest node, the second quarter of the table's time.
_VIEW_SQL = """ AND node = (SELECT node FROM {t} WHERE node IS NOT NULL GROUP BY node ORDER BY count(*) DESC, node LIMIT 1)
AND ts >= (SELECT make_timestamp(a * 1000000) FROM ({r})) AND ts <= (SELECT make_timestamp(z * 1000000) FROM ({r}))"""
_RANGE_SQL = "SELECT lo + (hi - lo) // 4 AS a, lo + (hi - lo) // 2 AS z FROM (SELECT floor(epoch_us(min(ts)) / 1e6)::bigint AS lo, ceil(epoch_us(max(ts)) / 1e6)::bigint AS hi FROM {t})"


def _view(df: DataFrame) -> dict[str, object]:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = df.agg(F.floor(F.min(us) / 1e6), F.ceil(F.max(us) / 1e6)).first()
    node = df.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").first()["node"]
    at = lambda s: dt.datetime.fromtimestamp(s, dt.UTC).replace(tzinfo=None)
    return {"node": node, "start": at(lo + (hi - lo) // 4), "end": at(lo + (hi - lo) // 2)}


for _name, (_table, _key, _value, _where) in _CHARTS.items():

    def _chart(spark, d, viewed=False, t=_table, k=_key, v=_value, w=_where, log=_name == "log_avg"):  # noqa: ANN001, ANN202
        df = load(spark, d, t)
        return dash.averages(df, k, v, F.expr(w), log, **(_view(df) if viewed else {}))

    R.add(f"dash_{_name}", _chart, _chart_sql(_table, _key, _value, _where, _name == "log_avg"))
    _range = _RANGE_SQL.format(t=_table)
    R.add(
        f"dash_{_name}_viewed",
        lambda spark, d, f=_chart: f(spark, d, True),
        _chart_sql(_table, _key, _value, _where, _name == "log_avg", _VIEW_SQL.format(t=_table, r=_range), f"(SELECT greatest((z - a) // 100, 1) AS tp FROM ({_range}))"),
    )


def dash_nodes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "prc").select("node").distinct().orderBy("node")


def dash_latest(spark: SparkSession, d: str) -> DataFrame:
    return dash.latest_status(load(spark, d, "node_role"))


def dash_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """All processes at the time of the last report, which is a snapshot's only by chance."""
    return dash.snapshot(load(spark, d, "prc"), load(spark, d, "node_role")).distinct()


def dash_snapshot_nearest(spark: SparkSession, d: str) -> DataFrame:
    return dash.snapshot(load(spark, d, "prc"), load(spark, d, "node_role"), nearest=True).distinct()


def dash_history(spark: SparkSession, d: str) -> DataFrame:
    """One process, by pid or name, on every node."""
    return dash.history(load(spark, d, "prc"), ["pid", "dreductions", "reductions", "memory", "dmemory", "message_queue_len"], "<0.116.0>", "lease_book")


def dash_history_viewed(spark: SparkSession, d: str) -> DataFrame:
    """The process with the most readings, in the viewer's node and range."""
    prc, view = load(spark, d, "prc"), _view(load(spark, d, "prc"))
    seen = dash.selected(prc, **view).groupBy("pid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pid").first()
    return dash.history(prc, ["pid", "dreductions", "reductions", "memory", "dmemory", "message_queue_len"], pid=seen["pid"] if seen else "none", **view)


def dash_not_similar(spark: SparkSession, d: str) -> DataFrame:
    """What processes do other than wait in a server's loop, with their stack traces."""
    return dash.history(load(spark, d, "prc"), ["pid", "current_function", "current_stacktrace"], not_in="gen_server:loop/")


def node_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Node names as the insert trigger keeps them: once each, conflicts ignored."""
    return load(spark, d, "app_top").where("node IS NOT NULL").select("node").dropDuplicates(["node"])


R.add("dash_nodes", dash_nodes, "SELECT DISTINCT node FROM prc ORDER BY node")
R.add("dash_latest", dash_latest, 'SELECT node, ts, data FROM node_role WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY ts DESC, "offset" DESC) = 1')
_PROCESS_SQL = ", ".join(dash.PROCESS)
R.add("dash_snapshot", dash_snapshot, f"SELECT DISTINCT node, ts, {_PROCESS_SQL} FROM prc WHERE (node, ts) IN (SELECT node, max(ts) FROM node_role GROUP BY node)")
R.add("dash_snapshot_nearest", dash_snapshot_nearest, f"""WITH r AS (SELECT node, max(ts) AS r FROM node_role GROUP BY node), a AS (SELECT node, max(ts) AS ts FROM prc JOIN r USING (node) WHERE ts <= r.r GROUP BY node)
SELECT DISTINCT node, ts, {_PROCESS_SQL} FROM prc SEMI JOIN a USING (node, ts)""")
_HISTORY_SQL = "SELECT node, ts, pid, dreductions, reductions, memory, dmemory, message_queue_len FROM prc WHERE ts IS NOT NULL AND "
R.add("dash_history", dash_history, _HISTORY_SQL + "(pid = '<0.116.0>' OR registered_name = 'lease_book')")
_PRC_VIEW = _VIEW_SQL.format(t="prc", r=_RANGE_SQL.format(t="prc"))
R.add("dash_history_viewed", dash_history_viewed, f"{_HISTORY_SQL} pid = (SELECT pid FROM prc WHERE true {_PRC_VIEW} GROUP BY pid ORDER BY count(*) DESC, pid LIMIT 1) {_PRC_VIEW}")
R.add("dash_not_similar", dash_not_similar, "SELECT node, ts, pid, current_function, current_stacktrace FROM prc WHERE ts IS NOT NULL AND current_function NOT SIMILAR TO 'gen_server:loop/.*'")
R.add("node_first_seen", node_first_seen, "SELECT DISTINCT node FROM app_top WHERE node IS NOT NULL")


# progress
def safe_offset_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.safe_offsets(_chunks(spark, d, FULL)).select("partition", substreams.route_head().alias("route_head"), "chunk", "offset", "is_open", "safe")


def committed_offset(spark: SparkSession, d: str) -> DataFrame:
    return audit.committed(_chunks(spark, d, FULL)).select("partition", "committed")


SAFE_SQL = COUNT_SQL + f""", o AS (SELECT *, n < {FULL} AS is_open FROM c),
s AS (SELECT a."partition", a.event_type, a.chunk, a."offset", a.is_open,
  CASE WHEN a.is_open THEN a."offset" ELSE least(a."offset", coalesce((SELECT min(b.first_offset) - 1 FROM o b
    WHERE b."partition" = a."partition" AND b.first_offset <= a."offset" AND (b.is_open OR b."offset" > a."offset")), a."offset")) END AS safe FROM o a)
"""
R.add("safe_offset_audit", safe_offset_audit, SAFE_SQL + 'SELECT "partition", event_type AS route_head, chunk, "offset", is_open, safe FROM s')
R.add("committed_offset", committed_offset, SAFE_SQL + 'SELECT "partition", max(safe) AS committed FROM s WHERE NOT is_open GROUP BY "partition"')


# streams
def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return with_envelope(source(spark, f"{d}/events.parquet"), "events", F.col("user_id") % 5, F.col("event_id"))


def stream_filter(spark: SparkSession, d: str) -> DataFrame:
    out = stateless.filter_rows(F.col("value") > 50)(_event_stream(spark, d)).select("partition", "offset", "event_type", "value")
    return stream_chunks.to_table(out, stream_chunks.fresh_root(spark, "filter"))


def stream_count_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = substreams.demux(F.col("event_type"))(_event_stream(spark, d))
    out = stream_chunks.to_table(stream_chunks.chunk_stream(rows, FULL, "user_id"), stream_chunks.fresh_root(spark, "chunks"))
    return out.select("partition", substreams.route_head().alias("route_head"), "chunk", "first_offset", "offset", "n", F.col("total").cast("long").alias("total"))


def _slices(df: DataFrame) -> DataFrame:
    num, cnt = header("slice_num").cast("int").alias("num"), header("slice_cnt").cast("int").alias("cnt")
    return df.where("topic = 'kf.objects'").select("topic", "partition", F.col("key").cast("string").alias("key"), "offset", num, cnt, "value")


def stream_assemble(spark: SparkSession, d: str) -> DataFrame:
    out = stream_chunks.assemble_stream(_slices(source(spark, f"{d}/messages.parquet")))
    return stream_chunks.to_table(out, stream_chunks.fresh_root(spark, "objects")).drop("topic")


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    j = rec.json_objects(source(spark, f"{d}/messages.parquet").where("topic = 'kf.upserts'"), "foo string, bar string")
    return stream_chunks.upsert_stream(j.select("partition", "offset", "foo", "bar"), ["partition", "foo"], stream_chunks.fresh_root(spark, "upsert"))


class _Spree(chunking.Aggregate):
    """Adds up values until 200 are reached; an error closes what came before it; the state is forgotten with each result."""

    def __init__(self) -> None:
        self.n, self.total = 0, 0.0

    def add(self, offset: int, row) -> str:  # noqa: ANN001, ARG002
        if row.event_type == "error" and self.n:
            return "reject"
        self.n, self.total = self.n + 1, self.total + row.value
        return "flush" if self.total >= 200 else "keep"

    def result(self) -> chunking.Exit:
        return chunking.Exit((self.n, round(self.total, 6)))


_SPREE = "n long, total double"


def user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    out = pipe(substreams.demux(F.col("user_id") % 7), chunking.aggregate_by(_Spree, _SPREE))(_events(spark, d))
    return out.select("partition", substreams.route_head().alias("route_head"), "offset", "n", F.round("total", 4).alias("total"))


def stream_user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    rows = substreams.demux(F.col("user_id") % 7)(_event_stream(spark, d))
    out = stream_chunks.to_table(stream_chunks.aggregate_stream(rows, _Spree, _SPREE), stream_chunks.fresh_root(spark, "spree"))
    return out.select("partition", substreams.route_head().alias("route_head"), "offset", "n", F.round("total", 4).alias("total"))


R.add("stream_filter", stream_filter, f'SELECT "partition", "offset", event_type, value FROM ({EVENTS_SQL}) WHERE value > 50')
R.add("stream_chunks", stream_count_chunks, COUNT_SQL + f'SELECT "partition", event_type AS route_head, chunk, first_offset, "offset", n, total FROM c WHERE n = {FULL}')
R.add("stream_assemble", stream_assemble, OBJECTS_SQL + """SELECT "partition", decode("key") AS "key", "offset", retransmission, corrupted, n_slices,
CASE WHEN NOT retransmission THEN coalesce(length(content) // 2, 0)::bigint END AS n_bytes FROM a""")
R.add("stream_upsert", stream_upsert, R.sql["upsert_latest"])
# the greedy cut, row by row
_SPREE_SQL = f"""WITH RECURSIVE e AS (SELECT "partition", user_id % 7 AS k, event_type, value, "offset",
  row_number() OVER (PARTITION BY "partition", user_id % 7 ORDER BY "offset") AS i FROM ({EVENTS_SQL})),
s AS (SELECT "partition", k, i, "offset", value AS total, 1::bigint AS n, value >= 200 AS done, NULL::bigint AS cut_at, NULL::bigint AS cut_n, NULL::double AS cut_total FROM e WHERE i = 1
  UNION ALL SELECT e."partition", e.k, e.i, e."offset",
    CASE WHEN s.done OR e.event_type = 'error' THEN e.value ELSE s.total + e.value END,
    CASE WHEN s.done OR e.event_type = 'error' THEN 1 ELSE s.n + 1 END,
    CASE WHEN s.done OR e.event_type = 'error' THEN e.value ELSE s.total + e.value END >= 200,
    CASE WHEN NOT s.done AND e.event_type = 'error' THEN s."offset" END, CASE WHEN NOT s.done AND e.event_type = 'error' THEN s.n END,
    CASE WHEN NOT s.done AND e.event_type = 'error' THEN s.total END
  FROM s JOIN e ON e."partition" = s."partition" AND e.k = s.k AND e.i = s.i + 1),
c AS (SELECT "partition", k, "offset", n, total FROM s WHERE done UNION ALL SELECT "partition", k, cut_at, cut_n, cut_total FROM s WHERE cut_at IS NOT NULL)
"""
_SPREE_OUT = 'SELECT "partition", k::varchar AS route_head, "offset", n, round(total, 4) AS total FROM c'
R.add("stream_user_aggregate", stream_user_aggregate, _SPREE_SQL + _SPREE_OUT)
_LAST = 'SELECT "partition", k, max(i) AS i FROM s GROUP BY ALL'
R.add("user_aggregate", user_aggregate, _SPREE_SQL + _SPREE_OUT + f""" UNION ALL SELECT s."partition", s.k::varchar, s."offset", s.n, round(s.total, 4) FROM s JOIN ({_LAST}) USING ("partition", k, i) WHERE NOT s.done""")


# progress of unfolded and hidden records, positions
def unfold_safe_offsets(spark: SparkSession, d: str) -> DataFrame:
    docs = with_envelope(load(spark, d, "documents").select("doc_id", "text"), "documents", F.lit(0), F.col("doc_id")).withColumn("safe", F.col("offset"))
    out = stateless.unfold(F.split("text", "\n"), "line", safe="safe")(docs)
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("safe") == F.col("offset")).alias("n_whole"), F.min("safe").alias("least"), F.max_by("safe", "ord").alias("last"))


def hidden_forwarded(spark: SparkSession, d: str) -> DataFrame:
    """Which records hidden by a filter advance the commit: those between the pairs of their partition."""
    rows = substreams.demux(F.lit("all"))(_events(spark, d))
    chunks = chunking.chunk_by_count(2)(rows.where("value > 20"))
    return audit.forwarded(rows.where("NOT value > 20"), chunks).select("partition", "offset")


def _sentences(row) -> list[tuple]:  # noqa: ANN001
    return [(x.strip(), len(x.strip())) for x in (row.props or "").strip("{}").split(":")]


def unfold_python(spark: SparkSession, d: str) -> DataFrame:
    """Python code that takes the properties of an event apart."""
    out = stateless.unfold_rows(_sentences, "item string, n long")(_events(spark, d))
    return out.select("partition", "offset", F.element_at("ord", -1).alias("pos"), "item", "n")


def commit_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions after the chunks of two halves of the input were committed one after the other, and the first once more."""
    store = OffsetStore(spark, scratch(spark, "positions"))
    chunks = _chunks(spark, d, FULL)
    whole = audit.committed(chunks)
    for rows in (audit.committed(chunks.where("offset < 3000")), whole, audit.committed(chunks.where("offset < 3000"))):
        store.commit(rows)
    return store.table().select("partition", "position")


R.add("unfold_safe_offsets", unfold_safe_offsets, """WITH u AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n, 1::bigint AS n_whole, CASE WHEN n > 1 THEN doc_id - 1 ELSE doc_id END AS least, doc_id AS last FROM u""")
R.add("unfold_python", unfold_python, f"""SELECT "partition", "offset", (i - 1)::int AS pos, trim(s[i]) AS item, length(trim(s[i]))::bigint AS n
FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, string_split(trim(coalesce(props, ''), '{{}}'), ':') AS s FROM ({EVENTS_SQL})))""")
R.add("hidden_forwarded", hidden_forwarded, f"""WITH e AS ({EVENTS_SQL}),
r AS (SELECT "partition", "offset", (row_number() OVER (PARTITION BY "partition" ORDER BY "offset") - 1) // 2 AS c FROM e WHERE value > 20),
c AS (SELECT "partition", min("offset") AS a, max("offset") AS z, count(*) = 2 AS closed FROM r GROUP BY "partition", c)
SELECT "partition", "offset" FROM e WHERE NOT value > 20 AND NOT EXISTS (SELECT 1 FROM c WHERE c."partition" = e."partition" AND c.a < e."offset" AND (NOT c.closed OR c.z > e."offset"))""")
R.add("commit_positions", commit_positions, SAFE_SQL + 'SELECT "partition", max(safe) + 1 AS position FROM s WHERE NOT is_open GROUP BY "partition"')


# sinks, run to the end
def retransmit_produced(spark: SparkSession, d: str) -> DataFrame:
    """Topic to topic through a queue, and read back: the offsets of the new topic are dense."""
    queue = FileQueue(spark, scratch(spark, "queue"))
    m = _messages(spark, d, "kf.numbers")
    send = workflows.retransmit_to(queue, "out", 5, partition=F.coalesce(F.col("key").cast("string").try_cast("long") % 5, F.lit(0)))
    half = F.lit(2000)
    for number, rows in ((0, m.where(F.col("offset") < half)), (1, m.where(F.col("offset") >= half)), (1, m.where(F.col("offset") >= half))):
        send(rows, number)
    out = queue.read("out")
    return out.groupBy("partition").agg(
        F.count("*").alias("n"), F.countDistinct("offset").alias("n_offsets"), F.max("offset").alias("last"), F.sum(F.octet_length("value")).alias("bytes"), F.count(F.nullif(F.size("headers"), F.lit(-1))).alias("n_headers")
    )


def loopback(spark: SparkSession, d: str) -> DataFrame:
    """Two pipes glued together: what the first produces is the stream the second chunks."""
    queue = FileQueue(spark, scratch(spark, "queue"))
    first = pipe(stateless.filter_rows(F.col("value") > 20), stateless.map_rows(key=F.col("event_type").cast("binary"), value=F.col("value").cast("string").cast("binary")))
    queue.produce(first(_events(spark, d)), "between")
    rows = with_envelope(queue.stream("between"), F.col("topic"), F.col("partition"), F.col("offset")).withColumn("amount", F.col("value").cast("string").cast("double"))
    rows = substreams.demux(F.col("key").cast("string"))(rows)
    out = stream_chunks.to_table(stream_chunks.chunk_stream(rows, 10, "amount"), stream_chunks.fresh_root(spark, "second"))
    return out.select("partition", substreams.route_head().alias("route_head"), "chunk", "first_offset", "offset", "n", F.round("total", 4).alias("total"))


def objects_written(spark: SparkSession, d: str) -> DataFrame:
    """Objects written slice by slice, then read back from where they lie."""
    at = scratch(spark, "objects").removeprefix("file:")
    m = _messages(spark, d, "kf.objects").withColumn("key", F.concat_ws("-", "partition", F.coalesce(F.col("key").cast("string"), F.lit("none"))).cast("binary"))
    done = cut(workflows.write_objects(at, part_bytes=64)(m))
    there = spark.read.format("binaryFile").load(at).select("path", "content") if done.where("NOT deleted").count() else spark.createDataFrame([], "path string, content binary")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    both = done.select(name("path").alias("name"), "offset", "deleted", "n_bytes").join(there.select(name("path").alias("name"), F.md5(F.hex("content")).alias("content_md5")), "name", "full")
    return both


def database_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last version of each key in a database, upserted in two batches, and read back."""
    at = scratch(spark, "db").removeprefix("file:") + ".sqlite"
    link = _sqlite(at)()
    link.execute("CREATE TABLE kv (part INTEGER, foo TEXT, bar TEXT, _offset INTEGER, PRIMARY KEY (part, foo))")
    link.commit()
    rows = rec.json_objects(_messages(spark, d, "kf.upserts"), "foo string, bar string").select("offset", "ord", F.col("partition").alias("part"), "foo", "bar").where("foo IS NOT NULL")
    for part in (rows.where("offset % 2 = 0 OR offset < 500"), rows.where("offset >= 500")):
        tables.write_rows(part, _sqlite(at), "kv", ["part", "foo", "bar", "_offset"], ["part", "foo"]).collect()
    found = link.execute("SELECT part, foo, bar FROM kv").fetchall()
    link.close()
    return spark.createDataFrame(found, "part int, foo string, bar string")


def _sqlite(at: str):  # noqa: ANN202
    def connect():  # noqa: ANN202
        import sqlite3

        return sqlite3.connect(at, timeout=120)

    return connect


def payload_slices(spark: SparkSession, d: str) -> DataFrame:
    """Four slices of 40 bytes of the payload of each customer."""
    ids = load(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    value = payload.stream_slice(F.col("c_custkey"), F.col("i") * 40, F.lit(40))
    return ids.select("c_custkey", (F.col("i") + 1).alias("num"), F.lower(F.hex(value)).alias("value"), payload.byte_at(F.col("c_custkey"), F.col("i") * 40).alias("first_byte"))


def helpers(spark: SparkSession, d: str) -> DataFrame:
    """The scalar helpers over the functions of process records."""
    f = load(spark, d, "fun_top")
    m = F.nullif(F.regexp_extract("fun", "^([^:]*):", 1), F.lit(""))
    name, arity = F.regexp_extract("fun", ":([^/]*)/", 1), F.regexp_extract("fun", "/([0-9]+)$", 1).try_cast("int")
    return f.select(
        "partition", "offset", rec.format_function(m, name, arity).alias("formatted"), rec.to_text(F.col("fun"), 7).alias("short"),
        rec.nullable(F.col("fun_type"), "initial_call").alias("kind"), rec.path_join(F.lit("/a"), F.col("fun_type")).alias("path"),
        rec.format_stacktrace(F.array("fun", "fun_type")).alias("trace"), hash_partition(F.coalesce(F.col("fun"), F.lit("")).cast("binary"), 5).between(0, 4).alias("in_range"),
    ).distinct()


def route_stage_case(spark: SparkSession, d: str) -> DataFrame:
    """A stage of its own for each route: clicks in pairs, errors in threes, the rest in tens."""
    by = {"click": chunking.chunk_by_count(2), "error": chunking.chunk_by_count(3)}
    out = pipe(substreams.demux(F.col("event_type")), substreams.route_stages(by, chunking.chunk_by_count(10)))(_events(spark, d))
    return out.select("partition", substreams.route_head().alias("route_head"), "chunk", "first_offset", "offset", "n")


class _Sizes(Assembler):
    """The size of an object, added up slice by slice."""

    def __init__(self) -> None:
        super().__init__()
        self.n, self.size = 0, 0

    def number(self, row) -> int:  # noqa: ANN001
        return row.num

    def count(self, row) -> int:  # noqa: ANN001
        return row.cnt

    def take(self, offset: int, row) -> None:  # noqa: ANN001, ARG002
        self.n, self.size = self.n + 1, self.size + row.length

    def finish(self) -> tuple:
        return (False, self.corrupted, self.n, self.size)

    def lost(self) -> tuple:
        return (True, False, 0, None)


_SIZES = "retransmission boolean, corrupted boolean, n_slices int, n_bytes long"


def _numbered_slices(df: DataFrame) -> DataFrame:
    num, cnt = header("slice_num").cast("int").alias("num"), header("slice_cnt").cast("int").alias("cnt")
    key = F.coalesce(F.col("key").cast("string"), F.lit("<null>"))
    rows = df.where("topic = 'kf.objects'").select("topic", "partition", "offset", "ord", "route", key.alias("k"), num, cnt, F.coalesce(F.octet_length("value"), F.lit(0)).alias("length"))
    return substreams.demux(F.col("k"))(rows)


def assembler_class(spark: SparkSession, d: str) -> DataFrame:
    out = assemble_by(_Sizes, _SIZES)(_numbered_slices(_messages(spark, d, "kf.objects")))
    return out.select("partition", F.nullif(substreams.route_head(), F.lit("<null>")).alias("key"), "offset", *[c.split()[0] for c in _SIZES.split(", ")])


def stream_assembler_class(spark: SparkSession, d: str) -> DataFrame:
    rows = _numbered_slices(with_envelope(source(spark, f"{d}/messages.parquet"), F.col("topic"), F.col("partition"), F.col("offset")))
    out = stream_chunks.to_table(stream_chunks.aggregate_stream(rows, _Sizes, _SIZES), stream_chunks.fresh_root(spark, "sizes"))
    return out.select("partition", F.nullif(substreams.route_head(), F.lit("<null>")).alias("key"), "offset", *[c.split()[0] for c in _SIZES.split(", ")])


R.add("retransmit_produced", retransmit_produced, """SELECT coalesce(try_cast(decode("key") AS bigint) % 5, 0)::int AS "partition", count(*) AS n, count(*) AS n_offsets, count(*) - 1 AS last,
sum(octet_length(value))::bigint AS bytes, count(headers) AS n_headers FROM messages WHERE topic = 'kf.numbers' GROUP BY 1""")
R.add("loopback", loopback, f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY "offset") - 1 AS o FROM ({EVENTS_SQL}) WHERE value > 20),
r AS (SELECT *, (row_number() OVER (PARTITION BY "partition", event_type ORDER BY o) - 1) // 10 AS chunk FROM e)
SELECT "partition", event_type AS route_head, chunk, min(o) AS first_offset, max(o) AS "offset", count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY ALL HAVING count(*) = 10""")
R.add("objects_written", objects_written, OBJECTS_SQL + """, l AS (SELECT * FROM a WHERE NOT retransmission QUALIFY row_number() OVER (PARTITION BY "partition", "key" ORDER BY "offset" DESC) = 1)
SELECT "partition"::varchar || '-' || coalesce(decode("key"), 'none') AS name, "offset", deleted, CASE WHEN deleted THEN 0 ELSE coalesce(length(content) // 2, 0) END::bigint AS n_bytes,
CASE WHEN NOT deleted THEN md5(coalesce(content, '')) END AS content_md5 FROM l""")
R.add("database_upsert", database_upsert, f"""SELECT "partition" AS part, foo, bar FROM ({R.sql["upsert_latest"]}) WHERE foo IS NOT NULL""")
R.add("payload_slices", payload_slices, """WITH i AS (SELECT c_custkey, unnest(range(0, 4)) AS i FROM customer),
h AS (SELECT c_custkey, i, list_aggregate([md5(c_custkey::varchar || ':' || n::varchar) FOR n IN range(0, 10)], 'string_agg', '') AS h FROM i)
SELECT c_custkey, (i + 1)::int AS num, substring(h, i * 80 + 1, 80) AS value, ('0x' || substring(h, i * 80 + 1, 2))::int AS first_byte FROM h""")
R.add("helpers", helpers, """SELECT DISTINCT "partition", "offset", CASE WHEN regexp_matches(fun, '^[^:]+:[^/]*/[0-9]+$') THEN regexp_extract(fun, '^([^:]*):', 1)[:30] || ':' || regexp_extract(fun, ':([^/]*)/', 1)[:40] || '/' || regexp_extract(fun, '/([0-9]+)$', 1)::int ELSE 'no data' END AS formatted,
fun[:7] AS short, nullif(fun_type, 'initial_call') AS kind, CASE WHEN fun_type IS NULL THEN '/a' ELSE '/a/' || fun_type END AS path,
to_json([fun, fun_type])::varchar AS trace, true AS in_range FROM fun_top""")
R.add("route_stage_case", route_stage_case, f"""WITH r AS (SELECT *, (row_number() OVER (PARTITION BY "partition", event_type ORDER BY "offset") - 1) // CASE event_type WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 10 END AS chunk FROM ({EVENTS_SQL}))
SELECT "partition", event_type AS route_head, chunk, min("offset") AS first_offset, max("offset") AS "offset", count(*) AS n FROM r GROUP BY ALL""")
_SIZES_SQL = OBJECTS_SQL + """SELECT "partition", decode("key") AS "key", "offset", retransmission, NOT retransmission AND corrupted AS corrupted, CASE WHEN retransmission THEN 0 ELSE n_slices END AS n_slices,
CASE WHEN NOT retransmission THEN coalesce(length(content) // 2, 0)::bigint END AS n_bytes FROM a"""
R.add("assembler_class", assembler_class, _SIZES_SQL)
R.add("stream_assembler_class", stream_assembler_class, _SIZES_SQL)
