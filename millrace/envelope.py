"""The envelope of a record: topic, partition, offset, order inside one offset, and route.

``offset`` grows inside a (topic, partition); ``ord`` keeps the order of records that one
input record was unfolded to; ``route`` is a stack of keys, the last pushed first, that splits
a partition into independent substreams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPE = ("topic", "partition", "offset", "ord", "route")
#: Substream of a stateful stage, and the order inside it.
STREAM, ORDER = ("topic", "partition", "route"), ("offset", "ord")


def with_envelope(df: DataFrame, topic: Column | str, partition: Column, offset: Column) -> DataFrame:
    """Adds the envelope to a table or stream that has its own columns for it."""
    name = F.lit(topic) if isinstance(topic, str) else topic
    return df.withColumns(
        {
            "topic": name,
            "partition": partition.cast("int"),
            "offset": offset.cast("long"),
            "ord": F.array().cast("array<int>"),
            "route": F.array().cast("array<string>"),
        }
    )
