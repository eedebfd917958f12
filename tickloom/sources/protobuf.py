"""Binary messages to columns and back through Spark's own protobuf package, where it is installed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode(rows: DataFrame, message: str, descriptor: bytes, value: str = "value") -> DataFrame:
    """Fields of the binary ``value``, absent scalars as their defaults; a malformed message fails the query."""
    from pyspark.sql.protobuf.functions import from_protobuf

    body = from_protobuf(
        value, message, binaryDescriptorSet=descriptor, options={"emit.default.values": "true", "mode": "FAILFAST"}
    )
    others = [c for c in rows.columns if c != value]
    return rows.select(*others, body.alias("_message")).select(*others, "_message.*")


def encode(fields: list[str], message: str, descriptor: bytes) -> Column:
    from pyspark.sql.protobuf.functions import to_protobuf

    return to_protobuf(F.struct(*fields), message, binaryDescriptorSet=descriptor)
