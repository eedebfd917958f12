"""Monitoring events: build, validate, reshape for the log store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import name_uuid
from ..functions.once import with_once
from ..schemas import MONITOR_EVENT

# Name in the event -> name in the log line.
LOG_FIELDS = {
    "message": "message", "timestamp": "timestamp", "messageId": "message_id", "level": "level",
    "serviceName": "service_name", "instanceId": "instance_id", "traceId": "trace_id",
    "host": "host", "environment": "environment", "metadata": "metadata",
}
# The few columns a log store indexes.
LABELS = ["service_name", "level", "environment"]


def monitor_event(
    rows: DataFrame, message: Column, level: Column, origin: str, at: Column, name: Column,
    instance: str = "spark", host: str = "spark", environment: str = "local", keep: list[str] | None = None,
) -> DataFrame:
    """Monitoring events for ``rows``, dropping those without message or level.

    ``name`` identifies the source row; message and trace ids derive from it and never change when
    a task runs twice. ``keep`` carries source columns along.
    """
    source = with_once(
        rows, "_event", F.struct(message.alias("message"), level.alias("level"), at.alias("at"), name.alias("name"))
    )
    events = source.select(
        *(keep or []),
        F.col("_event.message").alias("message"),
        F.col("_event.at").alias("timestamp"),
        name_uuid(F.concat_ws("|", "_event.name", F.lit(origin), "_event.level")).alias("messageId"),
        F.col("_event.level").alias("level"),
        F.lit(origin).alias("serviceName"),
        F.lit(instance).alias("instanceId"),
        name_uuid(F.concat_ws("|", "_event.name", F.lit("trace"))).alias("traceId"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.lit(host).alias("host"),
        F.lit(environment).alias("environment"),
    )
    return valid_monitor(events)


def read_monitor_json(messages: DataFrame, value: str = "value") -> DataFrame:
    """Decode JSON text into monitoring events, keeping the other columns."""
    others = [c for c in messages.columns if c != value]
    return messages.withColumn("_event", F.from_json(value, MONITOR_EVENT)).select(*others, "_event.*")


def valid_monitor(events: DataFrame) -> DataFrame:
    """Events whose message and level are both present and not empty."""
    return events.filter((F.length("message") > 0) & (F.length("level") > 0))


def reshape_monitor(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Snake-case log lines; every field not listed is dropped."""
    return events.select(*(keep or []), *(F.col(old).alias(new) for old, new in LOG_FIELDS.items()))
