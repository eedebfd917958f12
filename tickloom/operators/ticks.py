"""Quotes to price ticks, and the rows of a batch a table does not hold yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import parse_iso
from ..functions.fixed_point import mid_price
from ..schemas import PRICE
from .monitor import monitor_event

# A tick is the same tick if these agree. Ingest time is part of it, as in the table's unique key:
# a redelivered record is dropped, a message ingested again later is a new row.
TICK_KEY = ["time", "crypto_pair", "message_id"]
TICK_COLUMNS = ["time", "exchange", "crypto_pair", "price", "message_id"]

BAD_TIME, BAD_SCALE, NO_PRICE = "bad timestamp", "bad price scale", "no price"


def _mapped(quotes: DataFrame, time: Column | None = None) -> DataFrame:
    """Adds ``time``, ``tick_price`` and ``error``.

    Binance quotes have no last price, so their mid stands in. A last price is the mid of itself twice,
    which keeps one price expression for both exchanges.
    """
    sides = {
        f"_{side}": F.when(F.col("exchange") == "binance", F.col(side)).otherwise(F.col("price"))
        for side in ("best_bid", "best_ask")
    }
    rows = quotes.withColumns({**sides, "time": parse_iso(F.col("timestamp")) if time is None else time})
    return rows.withColumns({
        "tick_price": mid_price(F.col("_best_bid"), F.col("_best_ask"), F.col("price_scale")).cast(PRICE),
        "error": F.when(~F.coalesce(F.col("price_scale") >= 0, F.lit(False)), BAD_SCALE)
        .when(F.col("time").isNull(), BAD_TIME)
        .when(F.col("_best_bid").isNull() | F.col("_best_ask").isNull(), NO_PRICE),
    })


def to_ticks(quotes: DataFrame, keep: list[str] | None = None, time: Column | None = None) -> DataFrame:
    """The ticks of the quotes that map; one bad quote never holds up the rest.

    ``time`` replaces the parsed ISO text where the quotes already carry a timestamp column.
    """
    return _mapped(quotes, time).filter(F.col("error").isNull()).select(
        *(keep or []), "time", "exchange", "crypto_pair", F.col("tick_price").alias("price"), "message_id"
    )


def mapping_errors(quotes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The quotes that do not map, with the reason."""
    return _mapped(quotes).filter(F.col("error").isNotNull()).select(
        *(keep or []), "exchange", "crypto_pair", "message_id", "timestamp", "price_scale", "error"
    )


def mapping_audit(errors: DataFrame) -> DataFrame:
    """One ERROR monitoring event per quote that did not map."""
    # Fixed text: what log readers look for.
    message = F.concat(F.lit("Failed to map "), F.initcap("exchange"), F.lit(" ticker: "), F.col("error"))
    return monitor_event(
        errors, message, F.lit("ERROR"), origin="aggregations", at=F.col("timestamp"),
        name=F.concat_ws("|", "exchange", "message_id"),
    )


def first_copies(ticks: DataFrame, order: str = "arrival") -> DataFrame:
    """One row per tick key: the first to arrive, in one shuffle.

    Keys are nearly unique, so rows are not aggregated first. Spark limits a rank-one window within each task before
    the shuffle, so a key delivered very often still shrinks to one row per task.
    """
    first = F.row_number().over(Window.partitionBy(*TICK_KEY).orderBy(order))
    return ticks.withColumn("_rank", first).filter(F.col("_rank") == 1).drop("_rank")


def new_ticks(batch: DataFrame, stored: DataFrame, order: str = "arrival") -> DataFrame:
    """First copies of the batch whose key is not stored. Both steps use one partitioning on the key."""
    return first_copies(batch, order).join(stored.select(*TICK_KEY), TICK_KEY, "left_anti")


def within(column: Column, start: Column, end: Column) -> Column:
    """Half-open range ``[start, end)``."""
    return (column >= start) & (column < end)
