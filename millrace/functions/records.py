"""Decoding of tagged monitoring records, and the scalar helpers pipelines use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Tag of a record -> (table, fields in order with their types).
RECORDS = {
    "op_stat_kafka_msg1": ("opstat", "name string, data string, unit string, sess string, node string, ts timestamp_ntz"),
    "erl_top": (
        "prc",
        "node string, ts timestamp_ntz, pid string, dreductions double, dmemory double, reductions long, memory long, message_queue_len long, "
        "current_function string, initial_call string, registered_name string, stack_size long, heap_size long, total_heap_size long, "
        "current_stacktrace string, group_leader string",
    ),
    "fun_top": ("fun_top", "node string, ts timestamp_ntz, fun string, fun_type string, num_processes decimal(18,3)"),
    "app_top": ("app_top", "node string, ts timestamp_ntz, application string, unit string, value decimal(18,3)"),
    "node_role": ("node_role", "node string, ts timestamp_ntz, data string"),
}
LIMITS = {"pid": 34, "registered_name": 39, "application": 60, "name": 60, "data": 50, "unit": 10}


def fields_of(tag: str) -> list[tuple[str, str]]:
    return [tuple(f.strip().split(" ", 1)) for f in RECORDS[tag][1].replace("decimal(18,3)", "decimal").split(",")]  # type: ignore[misc]


def encode_record(tag: str, df: DataFrame) -> Column:
    """A record as JSON text ``[tag, field, ...]`` with string fields."""
    return F.to_json(F.array(F.lit(tag), *[F.col(f).cast("string") for f, _ in fields_of(tag)]))


def json_objects(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Adds the fields of JSON objects; rows whose text is null, no JSON or no object are left out."""
    text = F.col(value).cast("string")
    # a parser stops after the first value; inside a list and inside an object it has to read to the end
    inside = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v struct<{schema}>, _malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    rows = df.where((F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & text.rlike(r"^\s*\{")).withColumn("_j", inside)
    rows = rows.where(F.col("_j.v").isNotNull() & F.col("_j._malformed").isNull())
    return rows.select("*", *[F.col(f"_j.v.`{f}`") for f in StructType.fromDDL(schema).names]).drop("_j")


def decode_records(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``tag`` (null for unknown tags, wrong numbers of fields and unreadable text) and ``fields``."""
    text = F.col(value).cast("string")
    arr = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    tag = F.try_element_at(arr, F.lit(1))
    arity = F.lit(None).cast("int")
    for t in RECORDS:
        arity = F.when(tag == t, F.lit(len(fields_of(t)) + 1)).otherwise(arity)
    good = F.coalesce(F.size(arr) == arity, F.lit(False))
    return df.withColumn("_arr", arr).withColumns({"tag": F.when(good, tag), "fields": F.when(good, F.slice("_arr", 2, 64))}).drop("_arr")


def typed(df: DataFrame, tag: str) -> DataFrame:
    """Typed columns of the records of one tag; texts are cut to the table's limits. A record with a value that
    is not of its field's type is dropped as a whole, as one with the wrong number of fields is."""
    out, good = [], F.lit(True)
    for i, (name, kind) in enumerate(fields_of(tag)):
        raw = F.try_element_at("fields", F.lit(i + 1))
        kind = "decimal(18,3)" if kind == "decimal" else kind
        c = F.substring(raw, 1, LIMITS[name]) if kind == "string" and name in LIMITS else raw.try_cast(kind) if kind != "string" else raw
        if kind != "string":
            good = good & (raw.isNull() | c.isNotNull())
        out.append(c.alias(name))
    keep = [c for c in ("topic", "partition", "offset") if c in df.columns]
    return df.where((F.col("tag") == tag) & good).select(*keep, *out)


def to_text(c: Column, limit: int) -> Column:
    return F.substring(c.cast("string"), 1, limit)


def format_function(module: Column, function: Column, arity: Column) -> Column:
    """``module:function/arity`` with cut names; ``no data`` where a part is missing."""
    return F.coalesce(F.concat(F.substring(module, 1, 30), F.lit(":"), F.substring(function, 1, 40), F.lit("/"), arity.cast("string")), F.lit("no data"))


def nullable(c: Column, missing: str = "undefined") -> Column:
    return F.nullif(c, F.lit(missing))


def format_stacktrace(c: Column) -> Column:
    return F.to_json(c)


def path_join(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def rounded_bucket(ts: Column, seconds: float) -> Column:
    """Time bucket by rounding half away from zero, as a database cast to integer does."""
    return (F.round(F.unix_micros(ts.cast("timestamp")) / 1e6 / seconds) * seconds).cast("long")
