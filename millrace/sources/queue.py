"""Message-queue sources: client settings by name, and the defaults a pipeline needs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.envelope import with_envelope

# Option names of the queue's client.
_NAMES = {
    "endpoints": "kafka.bootstrap.servers", "protocol": "kafka.security.protocol", "mechanism": "kafka.sasl.mechanism",
    "jaas": "kafka.sasl.jaas.config", "timeout_ms": "kafka.request.timeout.ms", "truststore": "kafka.ssl.truststore.location",
    "compression": "kafka.compression.type", "create_topics": "kafka.allow.auto.create.topics",
}
_PLAIN = "org.apache.kafka.common.security.plain.PlainLoginModule required username={} password={};"


def client_options(clients: dict[str, dict[str, object]], name: str = "default", common: dict[str, object] | None = None) -> dict[str, str]:
    """Options of a named client; its own settings go before the common ones, and those before the defaults.

    Besides the client's option names: ``ssl`` (true or false) and ``sasl_file`` (two lines, user and
    password) set the protocol and the login. Topics are not created by mistake, messages are compressed.
    """
    merged = {"compression": "gzip", "create_topics": "false", **(common or {}), **clients[name]}
    ssl, login = merged.pop("ssl", None), merged.pop("sasl_file", None)
    if login:
        with open(str(login), encoding="utf-8") as f:
            user, password = (json.dumps(line.rstrip("\n")) for line in f.readlines()[:2])
        merged = {"mechanism": "PLAIN", "jaas": _PLAIN.format(user, password), **merged}
    if ssl is not None or login:
        merged.setdefault("protocol", ("SASL_" if login else "") + ("SSL" if ssl else "PLAINTEXT"))
    return {_NAMES.get(k, k): str(v) for k, v in merged.items()}


def read_options(topics: list[str], group: str | None = None, max_offsets: int | None = None, **client: str) -> dict[str, str]:
    """Reading starts at the earliest offset unless the client says otherwise; headers are read."""
    out = {"subscribe": ",".join(topics), "startingOffsets": "earliest", "includeHeaders": "true", **client}
    if group:
        out["groupIdPrefix"] = group
    if max_offsets:
        out["maxOffsetsPerTrigger"] = str(max_offsets)
    return out


def read_queue(spark: SparkSession, topics: list[str], connector: str = "kafka", **options: str) -> DataFrame:
    """Stream of messages with their envelope; needs the queue's connector on the class path."""
    raw = spark.readStream.format(connector).options(**read_options(topics, **options)).load()
    return with_envelope(raw, F.col("topic"), F.col("partition"), F.col("offset"))
