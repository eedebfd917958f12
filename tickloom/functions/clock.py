"""ISO timestamps and time buckets. Sessions run in UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date, 'T', time, and an offset that must be present.
ISO_OFFSET_TEXT = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?"
    r"(Z|[+-][0-9]{2}:[0-9]{2})$"
)


def parse_iso(text: Column) -> Column:
    """TIMESTAMP of ISO-8601 text with an offset; NULL for anything else."""
    with_seconds = F.when(F.substring(text, 17, 1) == ":", text).otherwise(
        F.concat(F.substring(text, 1, 16), F.lit(":00"), F.substring(text, 17, 6))
    )
    return F.when(text.rlike(ISO_OFFSET_TEXT), with_seconds.try_cast("timestamp"))


def iso_text(ts: Column) -> Column:
    """ISO-8601 text with microseconds and a ``Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def interval_text(span: timedelta) -> str:
    return f"{micros(span)} microseconds"


def bucket_start(ts: Column, size: timedelta, offset: timedelta = timedelta(0)) -> Column:
    """Start of the fixed bucket holding ``ts``; buckets count from the epoch plus ``offset``."""
    if offset:
        return F.window(ts, interval_text(size), startTime=interval_text(offset)).start
    return F.window(ts, interval_text(size)).start


def as_utc(moment: datetime) -> datetime:
    """A naive moment is read as UTC; the result is always aware."""
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def ts_literal(moment: datetime, like: str = "timestamp") -> Column:
    """Literal in the type of the column it is compared with, so the filter still reaches the scan."""
    text = as_utc(moment).strftime("%Y-%m-%d %H:%M:%S.%f")
    if like == "timestamp_ntz":
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "+00:00").cast("timestamp")
