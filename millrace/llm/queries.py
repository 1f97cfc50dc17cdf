"""Queries of the problems on training data (1, 8, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.common import cut, load
from millrace.llm import leakage, pii, quantiles, tokenize
from millrace.queries import Registry

R = Registry()
QUANTILES = [0.5, 0.9, 0.99, 0.999]
FIELDS = ["memory", "message_queue_len"]


# 1: percentiles of very large numeric columns
def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    prc = load(spark, d, "prc").select("partition", "offset", "node", "ts", *FIELDS)
    # the states of the days are written once and combined to those of the whole
    days = cut(quantiles.state(prc, [F.col("node"), F.to_date("ts")], FIELDS, ident=["partition", "offset"]))
    whole = days.groupBy("g0", F.lit(None).cast("date").alias("g1"), "field", "value").agg(F.sum("cnt").alias("cnt"))
    out = quantiles.percentiles(days.unionByName(whole), QUANTILES)
    day = F.coalesce(F.date_format("g1", "yyyy-MM-dd"), F.lit("all"))
    return out.select(F.col("g0").alias("node"), day.alias("day"), "field", "q", "value", "n_rows")


R.add(
    "p1_percentiles",
    p1_percentiles,
    """
WITH r AS (SELECT DISTINCT "partition", "offset", node, strftime(ts, '%Y-%m-%d') AS day, memory, message_queue_len FROM prc),
l AS (SELECT node, day, 'memory' AS field, memory AS v FROM r UNION ALL SELECT node, day, 'message_queue_len', message_queue_len FROM r),
s AS (SELECT node, day, field, v, pow(10, greatest(length(abs(v)::varchar) - 4, 0))::bigint AS st FROM l WHERE v IS NOT NULL),
m AS (SELECT node, day, field, sign(v) * (abs(v) - abs(v) % st + st // 2) AS value FROM s),
u AS (SELECT node, day, field, value, count(*) AS cnt FROM m GROUP BY ALL UNION ALL SELECT node, 'all', field, value, count(*) FROM m GROUP BY ALL),
c AS (SELECT *, sum(cnt) OVER (PARTITION BY node, day, field ORDER BY value) AS cum, sum(cnt) OVER (PARTITION BY node, day, field) AS n_rows FROM u)
SELECT node, day, field, q, value::bigint AS value, n_rows::bigint AS n_rows FROM c, (VALUES (0.5::double), (0.9::double), (0.99::double), (0.999::double)) t(q)
WHERE greatest(ceil(q * n_rows), 1) > cum - cnt AND greatest(ceil(q * n_rows), 1) <= cum""",
)


# 8: encoding of the whole corpus
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(load(spark, d, "documents"))


R.add("p8_ids", p8_ids)


# 9: evaluation texts in training text
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(load(spark, d, "documents"), load(spark, d, "eval_items"))


_WORDS_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(translate(prompt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM eval_items WHERE prompt IS NOT NULL),
dp AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
ip AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw))
"""
R.add("p9_found", p9_found, _WORDS_SQL + "SELECT DISTINCT doc_id, item_id FROM dp JOIN ip USING (p)")
R.add(
    "p9_spans",
    p9_spans,
    """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+')) AS t, unnest(range(1, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+')) + 1)) AS i FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, i, t, strlen(t) AS n, sum(strlen(t)) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM t),
w AS (SELECT doc_id, i, z - n AS a, z, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM e WHERE regexp_matches(t, '^[A-Za-z0-9]')),
dp AS (SELECT doc_id, a, lead(z, 11) OVER (PARTITION BY doc_id ORDER BY i) AS z,
  string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS p FROM w),
iw AS (SELECT item_id, regexp_extract_all(translate(prompt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM eval_items WHERE prompt IS NOT NULL),
ip AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw)),
h AS (SELECT doc_id, item_id, a, z FROM dp JOIN ip USING (p) WHERE z IS NOT NULL),
m AS (SELECT *, max(z) OVER (PARTITION BY doc_id, item_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM h),
g AS (SELECT *, sum(CASE WHEN high IS NULL OR a > high THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id ORDER BY a) AS span FROM m)
SELECT doc_id, item_id, min(a)::bigint AS first_byte, max(z)::bigint AS end_byte FROM g GROUP BY doc_id, item_id, span""",
)


# 10: personal information inside free text
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_lines(pii.find(load(spark, d, "documents")))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(load(spark, d, "documents"))


R.add("p10_found", p10_found)
R.add("p10_redacted", p10_redacted)
