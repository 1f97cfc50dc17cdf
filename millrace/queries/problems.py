"""Queries of the general data problems (2 to 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.common import load, scratch
from millrace.operators import grid, late, ledger, skew, spikes
from millrace.queries import Registry
from millrace.streaming.dedupe import dedupe_table, deliver_once

R = Registry()
APP_SOURCE = ["node", "application", "unit"]
PRC_FIELDS = [spikes.Field("dmemory", signed=True), spikes.Field("dreductions"), spikes.Field("message_queue_len", floor=100.0)]
APP_FIELDS = [spikes.Field("value")]


# 2: late and out-of-order events
def p2_method(spark: SparkSession, d: str) -> DataFrame:
    app = load(spark, d, "app_top").select("partition", "offset", "ts", *APP_SOURCE, "value")
    crowded = late.crowded_periods(app, APP_SOURCE)
    rows = late.mark_late(app, behind="behind").where("NOT is_late")
    in_order, out_of_order = (late.period_state(rows.where(c), APP_SOURCE, "value", crowded=crowded) for c in ("NOT behind", "behind"))
    return late.period_totals(late.correct(in_order, out_of_order, APP_SOURCE, "value"), APP_SOURCE, "value", crowded)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = late.mark_late(load(spark, d, "app_top").select("partition", "offset", "ts")).where("is_late")
    return rows.select(F.col("partition").alias("part_no"), F.col("offset").alias("msg_offset"))


_LATE_SQL = """
WITH d AS (SELECT DISTINCT "partition", "offset", node, ts, application, unit, value FROM app_top),
m AS (SELECT *, max(ts) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM d),
l AS (SELECT *, coalesce(ts < high - INTERVAL 30 MINUTE, false) AS is_late FROM m)
"""
R.add(
    "p2_method",
    p2_method,
    _LATE_SQL
    + """, a AS (SELECT node, application, unit, date_trunc('hour', ts)::timestamp AS period, value FROM l WHERE NOT is_late AND ts IS NOT NULL)
SELECT node, application, unit, period, count(*) AS n_records, count(DISTINCT value) AS n_distinct, sum(value) AS total,
       min(value) AS min_value, max(value) AS max_value, quantile_disc(value, 0.5) AS median
FROM a GROUP BY ALL""",
)
R.add("p2_found", p2_found, _LATE_SQL + 'SELECT "partition" AS part_no, "offset" AS msg_offset FROM l WHERE is_late')


# 3: irregular readings onto a regular grid
PRC_VALUES = ["memory", "reductions"]


def p3_method(spark: SparkSession, d: str) -> DataFrame:
    prc = load(spark, d, "prc").select("node", "ts", *PRC_VALUES)
    return grid.regular_series(prc, "node", "ts", PRC_VALUES).withColumnRenamed("source", "node")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_method(spark, d).where(F.col("status") != grid.OBSERVED).select("node", "slot_epoch")


def p3_marks(spark: SparkSession, d: str) -> DataFrame:
    """All of the filled series but the estimates, which SQL cannot make."""
    known = F.col("status") == grid.OBSERVED
    return p3_method(spark, d).select("node", "slot_epoch", "n_readings", "status", *[F.round(F.when(known, F.col(v)), 3).alias(v) for v in PRC_VALUES])


def p3_error(spark: SparkSession, d: str) -> DataFrame:
    prc = load(spark, d, "prc").select("node", "ts", *PRC_VALUES)
    return grid.fill_error(prc, "node", "ts", PRC_VALUES)


R.add("p3_method", p3_method)
R.add(
    "p3_found",
    p3_found,
    """
WITH s AS (SELECT DISTINCT node, (floor(epoch_us(ts) / 600000000) * 600)::bigint AS slot FROM prc WHERE node IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT node, slot // 86400 AS day, min(slot) AS a, max(slot) AS z FROM s GROUP BY ALL),
g AS (SELECT node, unnest(range(a, z + 1, 600)) AS slot_epoch FROM b)
SELECT node, slot_epoch FROM g WHERE (node, slot_epoch) NOT IN (SELECT node, slot FROM s)""",
)
R.add(
    "p3_marks",
    p3_marks,
    """
WITH s AS (SELECT node, (floor(epoch_us(ts) / 600000000) * 600)::bigint AS slot, count(*) AS n, avg(memory) AS memory, avg(reductions) AS reductions
  FROM prc WHERE node IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
b AS (SELECT node, slot // 86400 AS day, min(slot) AS a, max(slot) AS z FROM s GROUP BY ALL),
g AS (SELECT node, unnest(range(a, z + 1, 600)) AS slot FROM b),
p AS (SELECT node, slot // 86400 AS day, count(memory) AS m, count(reductions) AS r FROM s GROUP BY ALL),
q AS (SELECT slot % 86400 AS at, count(memory) AS m, count(reductions) AS r FROM s GROUP BY ALL)
SELECT g.node, g.slot AS slot_epoch, coalesce(s.n, 0) AS n_readings, round(s.memory, 3) AS memory, round(s.reductions, 3) AS reductions,
  CASE WHEN s.n IS NOT NULL THEN 'observed' WHEN p.m >= 3 AND p.r >= 3 AND q.m >= 2 AND q.r >= 2 THEN 'filled' ELSE 'unsupported' END AS status
FROM g LEFT JOIN s ON g.node = s.node AND g.slot = s.slot JOIN p ON g.node = p.node AND g.slot // 86400 = p.day LEFT JOIN q ON g.slot % 86400 = q.at""",
)
R.add("p3_error", p3_error)


# 4: implausible spikes
def p4_method(spark: SparkSession, d: str) -> DataFrame:
    prc = spikes.context_flags(load(spark, d, "prc"), ["node", "pid"], "ts", PRC_FIELDS)
    app = spikes.context_flags(load(spark, d, "app_top"), APP_SOURCE, "ts", APP_FIELDS)
    out = prc.withColumn("tbl", F.lit("prc")).unionByName(app.withColumn("tbl", F.lit("app_top")))
    return out.select("tbl", "field", F.col("partition").alias("part_no"), F.col("offset").alias("msg_offset"), "outside", "jump", "flat")


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    prc = spikes.flag_readings(load(spark, d, "prc"), ["node", "pid"], "ts", PRC_FIELDS)
    app = spikes.flag_readings(load(spark, d, "app_top"), APP_SOURCE, "ts", APP_FIELDS)
    return prc.withColumn("tbl", F.lit("prc")).unionByName(app.withColumn("tbl", F.lit("app_top")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_flags(spark, d).select("tbl", "field", F.col("partition").alias("part_no"), F.col("offset").alias("msg_offset"))


def p4_fences(spark: SparkSession, d: str) -> DataFrame:
    prc = spikes.context_fences(load(spark, d, "prc"), ["node", "pid"], "ts", PRC_FIELDS)
    app = spikes.context_fences(load(spark, d, "app_top"), APP_SOURCE, "ts", APP_FIELDS)
    return prc.withColumn("tbl", F.lit("prc")).unionByName(app.withColumn("tbl", F.lit("app_top")), allowMissingColumns=True)


_FLAGS_SQL = """
WITH r AS (
  SELECT DISTINCT 'prc' AS tbl, node AS k1, pid AS k2, '' AS k3, ts, "partition" AS p, "offset" AS o, dmemory, dreductions, message_queue_len::double AS mql FROM prc
  WHERE node IS NOT NULL AND pid IS NOT NULL),
l AS (
  SELECT tbl, k1, k2, k3, ts, p, o, 'dmemory' AS field, dmemory AS v FROM r
  UNION ALL SELECT tbl, k1, k2, k3, ts, p, o, 'dreductions', dreductions FROM r
  UNION ALL SELECT tbl, k1, k2, k3, ts, p, o, 'message_queue_len', mql FROM r
  UNION ALL SELECT DISTINCT 'app_top', node, application, unit, ts, "partition", "offset", 'value', value::double FROM app_top
  WHERE node IS NOT NULL AND application IS NOT NULL AND unit IS NOT NULL),
m AS (
  SELECT tbl, field, k1, k2, k3, median(abs(v)) FILTER (WHERE isfinite(v) AND v <> 0) AS med, min(v) < max(v) AS varies
  FROM l WHERE v IS NOT NULL GROUP BY ALL),
g AS (
  SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS brk FROM l WHERE v IS NOT NULL
  WINDOW w AS (PARTITION BY tbl, field, k1, k2, k3 ORDER BY ts, p, o)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY tbl, field, k1, k2, k3 ORDER BY ts, p, o) AS isl FROM g),
n AS (SELECT *, count(*) OVER (PARTITION BY tbl, field, k1, k2, k3, isl) AS len FROM i),
f AS (
  SELECT n.tbl, n.field, p, o,
    (NOT isfinite(v)) OR (v < 0 AND n.field <> 'dmemory') AS impossible,
    coalesce(isfinite(v) AND v <> 0 AND abs(v) >= 8 * med AND (n.field <> 'message_queue_len' OR abs(v) >= 100), false) AS spike,
    coalesce(len >= 8 AND v <> 0 AND varies, false) AS stuck
  FROM n JOIN m ON n.tbl = m.tbl AND n.field = m.field AND n.k1 = m.k1 AND n.k2 = m.k2 AND n.k3 = m.k3)
"""
R.add("p4_method", p4_method)
R.add("p4_found", p4_found, _FLAGS_SQL + "SELECT tbl, field, p AS part_no, o AS msg_offset FROM f WHERE impossible OR spike OR stuck")
R.add("p4_flags", p4_flags, _FLAGS_SQL + 'SELECT tbl, field, p AS "partition", o AS "offset", impossible, spike, stuck FROM f WHERE impossible OR spike OR stuck')
R.add("p4_fences", p4_fences)


# 5: a few keys holding most records
def _message_keys(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    return load(spark, d, "messages"), [F.col("topic"), F.col("partition"), F.col("offset"), F.col("batch_id")]


def _keyed(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, F.Column, list, F.Column]]:
    m, p = load(spark, d, "messages"), load(spark, d, "prc")
    return [
        ("messages.key", m, F.col("key").cast("string"), [F.col("topic"), F.col("partition"), F.col("offset"), F.col("batch_id")], F.octet_length("value").cast("long")),
        ("prc.node", p, F.col("node"), [F.col("partition"), F.col("offset")], F.col("memory")),
    ]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        skew.heavy_keys(skew.key_counts(df, key, salt)).select(F.lit(field).alias("field"), F.col("key").alias("hot_key"))
        for field, df, key, salt, _ in _keyed(spark, d)
    ]
    return parts[0].unionByName(parts[1])


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for field, df, key, salt, amount in _keyed(spark, d):
        heavy = skew.heavy_keys(skew.key_counts(df, key, salt))
        one = skew.salted_aggregate(
            df, key, heavy, salt,
            {"n": F.count("*"), "s": F.sum(amount), "hi": F.max(amount)},
            {"n_rows": F.sum("n"), "total": F.sum("s"), "largest": F.max("hi")},
        ).select(F.lit(field).alias("field"), "key", "n_rows", "total", "largest")
        out = one if out is None else out.unionByName(one)
    return out


R.add(
    "p5_found",
    p5_found,
    """
SELECT 'messages.key' AS field, decode("key") AS hot_key FROM messages WHERE "key" IS NOT NULL AND octet_length("key") > 0
GROUP BY "key" HAVING count(*) >= 0.03 * (SELECT count(*) FROM messages)
UNION ALL SELECT 'prc.node', node FROM prc WHERE node IS NOT NULL AND node <> '' GROUP BY node HAVING count(*) >= 0.03 * (SELECT count(*) FROM prc)""",
)
R.add(
    "p5_totals",
    p5_totals,
    """
SELECT 'messages.key' AS field, decode("key") AS "key", count(*) AS n_rows, sum(octet_length(value))::bigint AS total, max(octet_length(value))::bigint AS largest FROM messages GROUP BY "key"
UNION ALL SELECT 'prc.node', node, count(*), sum(memory)::bigint, max(memory) FROM prc GROUP BY node""",
)


# 6: messages delivered more than once
IDENT = ["topic", "partition", "offset"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    _, again = dedupe_table(spark, f"{d}/messages.parquet", columns=IDENT)
    return again.select("topic", F.col("partition").alias("part_no"), F.col("offset").alias("msg_offset")).distinct()


def p6_once(spark: SparkSession, d: str) -> DataFrame:
    once, _ = dedupe_table(spark, f"{d}/messages.parquet", columns=[*IDENT, "key", "value", "batch_id", "received_at"])
    return once.select(
        "topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.octet_length("value").alias("value_bytes"), "batch_id", "received_at"
    )


def p6_batches(spark: SparkSession, d: str) -> DataFrame:
    """The table as six deliveries in order of arrival, about one batch each; the store forgets after an hour."""
    messages = load(spark, d, "messages").select(*IDENT, "batch_id", "received_at")
    ms = F.unix_millis(F.col("received_at").cast("timestamp"))
    low, high = messages.agg(F.min(ms), F.max(ms)).first()
    slot = F.least(F.floor((ms - F.lit(low)) * 6 / F.lit(max(1, high - low))), F.lit(5))
    landed, files = scratch(spark, "landed"), messages.rdd.getNumPartitions()
    for i in range(6):
        messages.where(F.coalesce(slot, F.lit(0)) == i).repartition(files).write.parquet(f"{landed}/{i}")
    once, again = deliver_once(spark, f"{landed}/*", IDENT, "received_at", "batch_id", f"{landed}-once", delay="10 minutes", keep_ms=3_600_000, files_per_batch=files)
    copies = again.groupBy(*IDENT).agg(F.count("*").alias("n_again"))
    both = once.join(copies.select(*[F.col(c).alias(f"_{c}") for c in IDENT], "n_again"), F.expr(" AND ".join(f"{c} <=> _{c}" for c in IDENT)), "left")
    return both.select(*IDENT, "received_at", F.coalesce("n_again", F.lit(0)).alias("n_again"))


R.add("p6_found", p6_found, 'SELECT topic, "partition" AS part_no, "offset" AS msg_offset FROM messages GROUP BY ALL HAVING count(*) > 1')
R.add(
    "p6_once",
    p6_once,
    """
SELECT topic, "partition", "offset", decode("key") AS "key", octet_length(value) AS value_bytes, batch_id, received_at
FROM messages QUALIFY row_number() OVER (PARTITION BY topic, "partition", "offset" ORDER BY received_at, batch_id) = 1""",
)
R.add(
    "p6_batches",
    p6_batches,
    'SELECT topic, "partition", "offset", min(received_at) AS received_at, count(*) - 1 AS n_again FROM messages GROUP BY topic, "partition", "offset"',
)


# 7: only new records
def _messages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "messages").select("topic", "partition", "offset", F.octet_length("value").cast("long").alias("value_bytes"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    new = ledger.process_new(spark, _messages(spark, d), load(spark, d, "commit_log"), scratch(spark, "ledger"))
    return new.select("topic", F.col("partition").alias("part_no"), F.col("offset").alias("msg_offset")).distinct()


def p7_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Three runs of one ledger: over the lower half of the offsets of each partition, over all, and over all again."""
    data, log, root = _messages(spark, d), load(spark, d, "commit_log"), scratch(spark, "ledger")
    ends = data.groupBy("topic", "partition").agg(F.min("offset").alias("_lo"), F.max("offset").alias("_hi"))
    half = data.join(ends, ["topic", "partition"]).where(F.col("offset") <= F.expr("(_lo + _hi) div 2")).select(data.columns)
    out = None
    for number, rows in enumerate((half, data, data), 1):
        new = ledger.process_new(spark, rows, log, root, 5000).withColumn("round", F.lit(number))
        out = new if out is None else out.unionByName(new)
    return out.groupBy("round", "topic", "partition").agg(F.count("*").alias("n_rows"), F.countDistinct("offset").alias("n_offsets"), F.min("offset").alias("low"), F.max("offset").alias("high"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return ledger.plan_items(load(spark, d, "messages"), load(spark, d, "commit_log"), 100)


_COVERED_SQL = """WITH c AS (SELECT topic, "partition", max(to_offset) AS t FROM commit_log WHERE status = 'succeeded' GROUP BY ALL),
n AS (SELECT m.topic, m."partition", m."offset", c.t FROM messages m LEFT JOIN c ON m.topic = c.topic AND m."partition" = c."partition" WHERE c.t IS NULL OR m."offset" > c.t)
"""
R.add("p7_found", p7_found, _COVERED_SQL + 'SELECT DISTINCT topic, "partition" AS part_no, "offset" AS msg_offset FROM n')
R.add(
    "p7_rounds",
    p7_rounds,
    _COVERED_SQL
    + """, h AS (SELECT topic, "partition", (min("offset") + max("offset")) // 2 AS half FROM messages GROUP BY ALL)
SELECT CASE WHEN "offset" <= half THEN 1 ELSE 2 END AS round, topic, "partition", count(*) AS n_rows, count(DISTINCT "offset") AS n_offsets, min("offset") AS low, max("offset") AS high
FROM n JOIN h USING (topic, "partition") GROUP BY ALL""",
)
R.add(
    "p7_items",
    p7_items,
    _COVERED_SQL
    + """, e AS (SELECT topic, "partition", max(t) AS t, min("offset") AS lo, max("offset") AS hi FROM messages LEFT JOIN (SELECT topic, "partition", max(t) AS t FROM n GROUP BY ALL) USING (topic, "partition") GROUP BY ALL),
f AS (SELECT topic, "partition", coalesce(greatest(lo, c.t + 1), lo) AS a, hi FROM e LEFT JOIN c USING (topic, "partition")),
g AS (SELECT *, unnest(range(a // 100, hi // 100 + 1)) AS k FROM f WHERE a <= hi)
SELECT topic, "partition", greatest(a, k * 100) AS from_offset, least(hi, k * 100 + 99) AS to_offset FROM g""",
)
