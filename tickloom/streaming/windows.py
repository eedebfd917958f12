"""Stateful streams that Spark's own windows and watermarks express."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import interval_text
from ..operators.throttle import GRACE, WINDOW


def throttle_stream(
    quotes: DataFrame, size: timedelta = WINDOW, grace: timedelta = GRACE, time_col: str = "ts",
    arrival: str = "arrival",
) -> DataFrame:
    """The last quote by arrival per exchange, pair and window, emitted once the window closes (append mode).

    For a stream of one lane: Spark's watermark spans all rows of a query, so lanes that lag behind others would lose
    windows, and it is one batch behind, so a row the exact rule drops may still count. ``jobs.ThrottleStream`` holds the
    exact rule for any number of lanes.
    """
    keys = ["exchange", "crypto_pair"]
    others = [c for c in quotes.columns if c not in keys]
    return (
        quotes.withWatermark(time_col, interval_text(grace))
        .groupBy(*keys, F.window(time_col, interval_text(size)).alias("window"))
        .agg(F.max_by(F.struct(*others), F.col(arrival)).alias("_last"))
        .select(*keys, F.col("window.start").alias("window_start"), "_last.*")
    )


def dedupe_stream(ticks: DataFrame, horizon: timedelta) -> DataFrame:
    """First copy of each tick key among those within ``horizon`` of each other; state stays bounded. The
    append job's check against the stored table is the hard guarantee."""
    return ticks.withWatermark("time", interval_text(horizon)).dropDuplicatesWithinWatermark(
        ["time", "crypto_pair", "message_id"]
    )
