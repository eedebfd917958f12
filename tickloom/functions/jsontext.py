"""Field text of a parsed JSON value, telling a missing field from a JSON null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node(parsed: Column, path: str) -> Column:
    """The value at ``path`` as VARIANT; NULL only when the path does not exist."""
    return F.try_variant_get(parsed, path, "variant")


def node_text(parsed: Column, path: str) -> Column:
    """Text at ``path``: NULL if missing, ``'null'`` for JSON null, JSON for a list or an object."""
    return F.when(F.is_variant_null(node(parsed, path)), F.lit("null")).otherwise(
        F.try_variant_get(parsed, path, "string")
    )


def label_text(parsed: Column, path: str) -> Column:
    """``node_text``, but a list or an object reads as the empty string."""
    kind = F.schema_of_variant(node(parsed, path))
    return F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit("")).otherwise(node_text(parsed, path))


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"^[ \t\r\n]*$")


def whole_number(text: Column) -> Column:
    """BIGINT of a JSON scalar's text: fractions are cut, ``true`` is 1, anything else is 0."""
    return F.coalesce(
        text.try_cast("bigint"),
        text.try_cast("decimal(38,18)").try_cast("bigint"),
        F.when(text == "true", F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
    )


def real_number(text: Column) -> Column:
    """DOUBLE of a JSON scalar's text: ``true`` is 1.0, anything unreadable is 0.0."""
    return F.coalesce(
        text.try_cast("double"),
        F.when(text == "true", F.lit(1.0)).otherwise(F.lit(0.0)),
    )
