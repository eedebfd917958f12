"""Last quote per pair and tumbling window, with the rule for late arrivals.

A lane is one ordered feed (a topic partition). Its clock is the highest event time seen so far, the
current row included. A row is late when its window's end plus the grace is at or before the clock.
Read the other way round: every window of a lane has a closing arrival, the first one whose time
reaches end plus grace, and the rows of that window that arrive after it are late. Closing arrivals come
from a small per-slot summary, so raw rows are neither sorted nor shuffled to find them.
"""

from __future__ import annotations

from datetime import timedelta
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import bucket_start, micros
from ..session import use_checkpoints
from .running import chunk_of, running
from .sizing import broadcast_if_small

# Window and grace of the live feeds.
WINDOW = timedelta(milliseconds=500)
GRACE = timedelta(milliseconds=1000)

# What an aggregation buffer holds in place.
_FIXED_WIDTH = (
    T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.DoubleType, T.FloatType, T.DateType,
    T.TimestampType, T.TimestampNTZType, T.DecimalType,
)

# Slots whose closing arrivals one task works out together.
_SLOTS_PER_CHUNK = 65_536


def lane_slots(
    rows: DataFrame, size: timedelta, grace: timedelta, time_col: str = "ts", lane: str = "exchange",
    arrival: str = "arrival",
) -> DataFrame:
    """The summary every late rule needs: first and last arrival and last time per lane and slot.

    Kept in the shared folder, as it is read several times: raw rows are scanned once for all of them.
    """
    use_checkpoints(rows.sparkSession)
    return (
        rows.select(lane, arrival, time_col, bucket_start(F.col(time_col), _step(size, grace)).alias("slot"))
        .groupBy(lane, "slot")
        .agg(F.min(arrival).alias("first_arrival"), F.max(arrival).alias("last_arrival"), F.max(time_col).alias("last_time"))
        .checkpoint()
    )


def _step(size: timedelta, grace: timedelta) -> timedelta:
    return timedelta(microseconds=gcd(micros(size), micros(grace)))


def closing_arrivals(slots: DataFrame, size: timedelta, grace: timedelta, lane: str = "exchange") -> DataFrame:
    """``lane, window_start, closed_by`` for the windows that have late rows: rows arriving after
    ``closed_by`` are late. ``slots`` comes from ``lane_slots``."""
    step = _step(size, grace)
    slots = (
        slots.withColumn("window_start", bucket_start(F.col("slot"), size))
        .withColumn("slot_us", F.unix_micros(F.col("slot").cast("timestamp")))
        .withColumn("closes_us", F.unix_micros(F.col("window_start").cast("timestamp")) + micros(size) + micros(grace))
    )
    # Each slot stands twice on its lane's time line: where it is, with its first arrival, and where its
    # window closes, asking for the earliest arrival from there on. Walking back in time answers that.
    marks = slots.select(
        lane, "window_start", "last_arrival",
        F.explode(F.array(
            F.struct((-F.col("slot_us")).alias("back"), F.lit(0).alias("asks"), F.col("slot_us").alias("of"),
                     F.col("first_arrival").alias("seen")),
            F.struct((-F.col("closes_us")).alias("back"), F.lit(1).alias("asks"), F.col("slot_us").alias("of"),
                     F.lit(None).cast("bigint").alias("seen")),
        )).alias("mark"),
    ).select(lane, "window_start", "last_arrival", "mark.*")
    chunk = chunk_of("back", micros(step) * _SLOTS_PER_CHUNK)
    answered = running(marks, [lane], ["back", "asks", "of"], chunk, {"closed_by": ("min", F.col("seen"))})
    return (
        answered.filter(F.col("asks") == 1)
        .groupBy(lane, "window_start")
        .agg(F.min("closed_by").alias("closed_by"), F.max("last_arrival").alias("last_arrival"))
        .filter(F.col("last_arrival") > F.col("closed_by"))
        .select(lane, "window_start", "closed_by")
    )


def _with_closing(
    rows: DataFrame, how: str, size: timedelta, grace: timedelta, time_col: str, lane: str, arrival: str,
    slots: DataFrame | None = None,
) -> DataFrame:
    if slots is None:
        slots = lane_slots(rows, size, grace, time_col, lane, arrival)
    closing = broadcast_if_small(closing_arrivals(slots, size, grace, lane))
    windowed = rows.withColumn("window_start", bucket_start(F.col(time_col), size))
    return windowed.join(closing, [lane, "window_start"], how)


def late_rows(
    rows: DataFrame, size: timedelta = WINDOW, grace: timedelta = GRACE, time_col: str = "ts",
    lane: str = "exchange", arrival: str = "arrival",
) -> DataFrame:
    """The rows the late rule drops."""
    late = _with_closing(rows, "inner", size, grace, time_col, lane, arrival)
    return late.filter(F.col(arrival) > F.col("closed_by")).select(*rows.columns)


def drop_late(
    rows: DataFrame, size: timedelta = WINDOW, grace: timedelta = GRACE, time_col: str = "ts",
    lane: str = "exchange", arrival: str = "arrival", slots: DataFrame | None = None,
) -> DataFrame:
    """Rows on time, with their ``window_start``."""
    marked = _with_closing(rows, "left", size, grace, time_col, lane, arrival, slots)
    return marked.filter(
        F.col("closed_by").isNull() | (F.col(arrival) <= F.col("closed_by"))
    ).select(*rows.columns, "window_start")


def latest_per_key(rows: DataFrame, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """The last row by arrival of each key; arrivals are unique within a key. Rows with a null in their key have none and are
    left out. Partial results form before the shuffle, so a hot key is merged from one row per task.

    Columns of fixed width are kept in the aggregation itself, which then hashes. Other columns would make Spark
    sort every row first; there only the last arrival is aggregated and the few winners are joined back.
    """
    rows = rows.dropna(subset=keys)
    others = [c for c in rows.columns if c not in keys and c != arrival]
    if all(isinstance(rows.schema[c].dataType, _FIXED_WIDTH) for c in others):
        last = rows.groupBy(*keys).agg(
            *(F.max_by(c, arrival).alias(c) for c in others), F.max(arrival).alias(arrival))
        return last.select(*keys, *(c for c in rows.columns if c not in keys))
    winners = rows.groupBy(*keys).agg(F.max(arrival).alias(arrival))
    return rows.join(winners, [*keys, arrival]).select(*keys, *(c for c in rows.columns if c not in keys))


def throttle_latest(
    rows: DataFrame, size: timedelta = WINDOW, grace: timedelta = GRACE, time_col: str = "ts",
    lane: str = "exchange", pair: str = "crypto_pair", arrival: str = "arrival", slots: DataFrame | None = None,
) -> DataFrame:
    """The last row by arrival per lane, pair and window, late rows left out."""
    on_time = drop_late(rows, size, grace, time_col, lane, arrival, slots)
    return latest_per_key(on_time, [lane, pair, "window_start"], arrival)


def throttle_closed(
    rows: DataFrame, size: timedelta = WINDOW, grace: timedelta = GRACE, time_col: str = "ts",
    lane: str = "exchange", pair: str = "crypto_pair", arrival: str = "arrival",
) -> DataFrame:
    """``throttle_latest`` without the windows that no later row of their lane has closed yet."""
    slots = lane_slots(rows, size, grace, time_col, lane, arrival)
    # one row per lane, from the summary: what is broadcast does not grow with the rows
    clock = F.broadcast(slots.groupBy(lane).agg(F.max("last_time").alias("_clock")))
    latest = throttle_latest(rows, size, grace, time_col, lane, pair, arrival, slots)
    return latest.join(clock, lane, "inner").filter(is_closed(F.col("window_start"), F.col("_clock"), size, grace)).drop("_clock")


def is_closed(window_start: Column, clock: Column, size: timedelta, grace: timedelta) -> Column:
    return window_start + F.expr(f"INTERVAL {micros(size + grace)} MICROSECONDS") <= clock
