"""Deterministic name-based ids (version 3 UUIDs), built from JVM-side string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_uuid(text: Column) -> Column:
    """Version 3 UUID of the UTF-8 bytes of ``text`` with no namespace.

    MD5, with the version digit set to 3 and the top two bits of the variant digit set to 10.
    """
    digest = F.md5(text)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-3"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def message_id(event_time: Column, pair: Column, volume: Column) -> Column:
    """Id of one exchange message: event time, pair and volume joined by a bar."""
    return name_uuid(F.concat_ws("|", event_time.cast("string"), pair, volume.cast("string")))


def pair_of_ids(left: Column, right: Column) -> Column:
    """Id of an event derived from two source messages."""
    return name_uuid(F.concat_ws("|", left, right))
