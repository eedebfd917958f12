"""Two-way executable spread between the latest quotes of two exchanges."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import micros
from ..functions.fixed_point import descale
from ..functions.ids import pair_of_ids
from .running import DEFAULT_CHUNK, chunk_of, running
from .sizing import broadcast_if_small
from .throttle import latest_per_key

SPREAD_COLUMNS = [
    "crypto_pair", "message_id", "timestamp", "binance_best_bid", "binance_best_ask",
    "coinbase_best_bid", "coinbase_best_ask", "spread_buy_binance_sell_coinbase",
    "spread_buy_coinbase_sell_binance",
]


def _side(exchange: str, carry: list[str]) -> Column:
    """A row's quote if it belongs to ``exchange``, else NULL."""
    return F.when(
        F.col("exchange") == exchange,
        F.struct("best_bid", "best_ask", "price_scale", "message_id", "timestamp", *carry),
    )


def _spread_rows(sides: DataFrame, keep: list[str], carry: list[str]) -> DataFrame:
    """Spread events from rows holding both quotes; nothing while one is missing."""
    both = sides.filter(F.col("_binance").isNotNull() & F.col("_coinbase").isNotNull())
    # scales were checked before, so no price is NULL here unless the quote's own was
    prices = {
        f"{side}_{field}": descale(F.col(f"_{side}.{field}"), F.col(f"_{side}.price_scale"))
        for side in ("binance", "coinbase") for field in ("best_bid", "best_ask")
    }
    priced = both.withColumns(prices)
    buy_binance = F.col("coinbase_best_bid") - F.col("binance_best_ask")
    buy_coinbase = F.col("binance_best_bid") - F.col("coinbase_best_ask")
    return priced.select(
        *keep,
        F.col("canonical_pair").alias("crypto_pair"),
        pair_of_ids(F.col("_binance.message_id"), F.col("_coinbase.message_id")).alias("message_id"),
        F.greatest("_binance.timestamp", "_coinbase.timestamp").alias("timestamp"),
        *(F.col(name).cast("double").alias(name) for name in prices),
        buy_binance.cast("double").alias("spread_buy_binance_sell_coinbase"),
        buy_coinbase.cast("double").alias("spread_buy_coinbase_sell_binance"),
        *(F.col(f"_{side}.{c}").alias(f"{side}_{c}") for side in ("binance", "coinbase") for c in carry),
    )


def usable_scale() -> Column:
    return F.coalesce(F.col("price_scale") >= 0, F.lit(False))


def scale_errors(rows: DataFrame) -> DataFrame:
    """The quotes no spread can be worked out for, with the reason. The spread operators leave them out, so a bad
    quote neither makes an event without prices nor hides the good one before it."""
    return rows.filter(~usable_scale()).withColumn("error", F.lit("bad price scale"))


def spread_snapshot(rows: DataFrame, arrival: str = "arrival", carry: list[str] | None = None) -> DataFrame:
    """Spread between the latest quote of each side, per canonical pair.

    The latest quote per pair and exchange comes from a hashed aggregation; only those few rows are then
    put side by side. ``carry`` names source columns to return for each side.
    """
    carry = carry or []
    needed = dict.fromkeys(["exchange", "canonical_pair", "best_bid", "best_ask", "price_scale", "message_id", "timestamp",
                            arrival, *carry])
    latest = latest_per_key(rows.filter(usable_scale()).select(*needed), ["canonical_pair", "exchange"], arrival)
    sides = latest.groupBy("canonical_pair").agg(
        *(F.max(_side(side, carry)).alias(f"_{side}") for side in ("binance", "coinbase")))
    return _spread_rows(sides, [], carry)


TIME_ORDER = ["ts", "exchange", "lane", "arrival"]
_TIME_CHUNK = timedelta(minutes=10)


def with_time_chunks(
    rows: DataFrame, keys: list[str], span: timedelta = _TIME_CHUNK, most: int = DEFAULT_CHUNK, name: str = "_time_chunk"
) -> DataFrame:
    """``rows`` with a chunk of ``ts`` that never decreases along ``TIME_ORDER``, of about ``most`` rows a key at most.

    Rows are counted by key and ``span``; where a span holds more, its rows are counted and parted again by spans 1,024 times
    shorter, and those once more. So a burst that puts a third of all rows into one minute is spread over many chunks,
    and only rows of one key within the same half millisecond stay together. The list of crowded spans has at most one row for
    ``most`` rows; it is broadcast if its measured bytes allow it.
    """
    at, step = F.unix_micros(F.col("ts").cast("timestamp")), micros(span)
    marked = rows.withColumn(name, at - F.pmod(at, F.lit(step)))
    for _ in range(2):
        step = max(1, step // 1024)
        crowded = marked.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).drop("_n")
        crowded = broadcast_if_small(crowded.withColumn("_crowded", F.lit(True)))
        if crowded.isEmpty():
            break
        finer = F.when(F.col("_crowded"), at - F.pmod(at - F.col(name), F.lit(step))).otherwise(F.col(name))
        marked = marked.join(crowded, [*keys, name], "left").withColumn("_finer", finer).drop(name, "_crowded") \
            .withColumnRenamed("_finer", name)
    return marked


def spread_changelog_by_time(
    rows: DataFrame, keep: list[str] | None = None, carry: list[str] | None = None, span: timedelta = _TIME_CHUNK,
    most: int = DEFAULT_CHUNK,
) -> DataFrame:
    """``spread_changelog`` for rows of several topics. A position only orders its own lane, so across lanes
    the record time decides, then exchange, lane and position."""
    chunked = with_time_chunks(rows, ["canonical_pair"], span, most)
    return spread_changelog(chunked, TIME_ORDER, F.col("_time_chunk"), keep, carry)


def spread_changelog(
    rows: DataFrame, order: list[str] | None = None, chunk: Column | None = None,
    keep: list[str] | None = None, carry: list[str] | None = None,
) -> DataFrame:
    """One spread event per quote of either side, paired with the other side's latest quote so far.

    ``order`` is the delivery order across both sides and ``chunk`` a column that never decreases along it;
    both default to the integer ``arrival``.
    """
    order = order or ["arrival"]
    carry = carry or []
    chunk = chunk_of(order[0]) if chunk is None else chunk
    needed = list(dict.fromkeys([
        "exchange", "canonical_pair", "best_bid", "best_ask", "price_scale", "message_id", "timestamp",
        *order, *carry, *(keep or []),
    ]))
    sides = running(
        rows.filter(usable_scale()).select(*needed, chunk.alias("_given")), ["canonical_pair"], order, F.col("_given"),
        {f"_{side}": ("last", _side(side, carry)) for side in ("binance", "coinbase")},
    )
    return _spread_rows(sides, keep or [], carry)
