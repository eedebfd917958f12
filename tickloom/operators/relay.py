"""Client feed: one JSON text per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _json_field(field: T.StructField) -> Column:
    """64-bit integers travel as JSON strings; absent scalars print their default."""
    value = F.col(field.name)
    if isinstance(field.dataType, T.LongType):
        return F.coalesce(value.cast("string"), F.lit("0")).alias(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(value, F.lit("")).alias(field.name)
    if isinstance(field.dataType, (T.IntegerType, T.DoubleType)):
        return F.coalesce(value, F.lit(0).cast(field.dataType)).alias(field.name)
    return value


def to_relay_json(events: DataFrame, message: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """``value``: JSON of the message's fields, snake-case names, defaults printed."""
    body = F.to_json(F.struct(*(_json_field(f) for f in message.fields)))
    return events.select(*(keep or []), body.alias("value"))
