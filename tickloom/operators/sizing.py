"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import use_checkpoints

BROADCAST_BYTES = 64 << 20
# What a hashed row costs beside its values.
_ROW_OVERHEAD = 32


def measured_bytes(rows: DataFrame) -> int:
    """Bytes of all rows as a hashed relation holds them, from one aggregation over their real lengths."""
    fixed, texts = _ROW_OVERHEAD, F.lit(0).cast("bigint")
    for field in rows.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            texts = texts + F.coalesce(F.octet_length(field.name), F.lit(0))
        fixed += 8
    return rows.agg(F.coalesce(F.sum(texts + fixed), F.lit(0))).first()[0]


def broadcast_if_small(rows: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` (flat columns) computed once into the shared checkpoint folder, and hinted for broadcast if their measured
    bytes allow it.

    Above the limit the caller's join stays a shuffle join that AQE may split where keys are skewed. The checkpoint is
    reliable, so a lost executor costs a re-read, and the plan that produced the rows does not run a second time.
    """
    use_checkpoints(rows.sparkSession)
    stored = rows.checkpoint()
    return F.broadcast(stored) if measured_bytes(stored) <= limit else stored
