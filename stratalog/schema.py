"""The event table and what derives from it."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

EVENT = StructType(
    [
        StructField("id", LongType(), False),
        StructField("source", StringType(), False),
        StructField("event_time", LongType(), False),
        StructField("received_at", LongType(), False),
        StructField("level", IntegerType(), False),
        StructField("service", StringType()),
        StructField("logger", StringType()),
        StructField("host", StringType()),
        StructField("pid", LongType()),
        StructField("message", StringType(), False),
        StructField("attributes", StringType(), False),
    ]
)
COLUMNS = EVENT.fieldNames()
#: Facets in their fixed order.
FACETS = ("service", "logger", "host", "level", "source")
MAX_TIME = 253_402_300_799_999
MAX_PROMOTED = 8


def stored_schema(promoted: int = 0) -> StructType:
    """Rows as files have them; files written before keys were promoted lack the last columns and read as null."""
    if not promoted:
        return EVENT
    return StructType([*EVENT.fields, StructField("pa_covered", BooleanType()), *[StructField(f"pa_{i}", StringType()) for i in range(promoted)]])
