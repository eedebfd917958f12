"""Price history: validate the request, choose a tier, read only that."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import as_utc, ts_literal
from ..operators.ohlc import OHLC_COLUMNS
from ..operators.pairs import to_canonical
from .tiers import Tier, select_tier

# Exchange names as stored.
EXCHANGES = ["binance", "coinbase"]


def normalize_exchange(exchange: str | None) -> str | None:
    """Stored name of an exchange given in any case; None means all."""
    if exchange is None:
        return None
    name = exchange.lower()
    if name not in EXCHANGES:
        raise ValueError(f"Unknown exchange '{exchange}'. Valid values: {[e.upper() for e in EXCHANGES]}")
    return name


def history_rows(
    points: DataFrame, pair: str, start: datetime, end: datetime, exchange: str | None = None
) -> DataFrame:
    """Points of one pair whose bucket starts in ``[start, end]``, both ends included."""
    like = dict(points.dtypes)["bucket"]
    rows = points.filter(
        (F.col("crypto_pair") == pair) & F.col("bucket").between(ts_literal(start, like), ts_literal(end, like))
    )
    if exchange is not None:
        rows = rows.filter(F.col("exchange") == exchange)
    return rows.select(*OHLC_COLUMNS)


def ohlc_history(
    read_tier: Callable[[Tier, datetime, datetime], DataFrame],
    pair: str, start: datetime, end: datetime, exchange: str | None = None,
) -> DataFrame:
    """Points of ``pair`` in time order, from the tier that fits the point budget.

    ``read_tier`` opens a tier for a range of bucket starts and may skip whatever lies outside.
    """
    start, end = as_utc(start), as_utc(end)
    if end <= start:
        raise ValueError("end must be after start")
    exchange = normalize_exchange(exchange)
    points = read_tier(select_tier(start, end), start, end)
    return history_rows(points, pair, start, end, exchange).orderBy("bucket", "exchange")


def compare_exchanges(points: DataFrame) -> DataFrame:
    """Both exchanges side by side per canonical pair and bucket, where both traded.

    One aggregation on the joint key instead of a self-join, so the tier is read and shuffled once.
    """
    sides = to_canonical(points).groupBy("canonical_pair", "bucket")
    picked = {
        f"{side}_{name}": F.max(F.when(F.col("exchange") == side, F.col(name)))
        for side in EXCHANGES for name in ("close", "avg_price", "tick_count")
    }
    rows = sides.agg(*(c.alias(n) for n, c in picked.items()))
    return rows.filter(
        F.col("binance_tick_count").isNotNull() & F.col("coinbase_tick_count").isNotNull()
    ).withColumn("close_difference", F.col("binance_close") - F.col("coinbase_close"))
