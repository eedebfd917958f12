"""Exchange-native pairs to the canonical pairs both exchanges list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Exchange, native pair, canonical pair. Only pairs every exchange lists appear.
PAIRS = [
    ("binance", "BTCUSDT", "BTC-USDT"),
    ("binance", "ETHUSDT", "ETH-USDT"),
    ("binance", "SOLUSDT", "SOL-USDT"),
    ("binance", "XRPUSDT", "XRP-USDT"),
    ("coinbase", "BTC-USDT", "BTC-USDT"),
    ("coinbase", "ETH-USD", "ETH-USDT"),
    ("coinbase", "SOL-USD", "SOL-USDT"),
    ("coinbase", "XRP-USD", "XRP-USDT"),
]


def pair_dimension(spark: SparkSession) -> DataFrame:
    """The pairs as constants of the plan, so Spark knows their size."""
    values = ", ".join(str(pair) for pair in PAIRS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS pairs(exchange, crypto_pair, canonical_pair)")


def to_canonical(rows: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Adds ``canonical_pair`` and drops rows whose pair is not in the dimension.

    The built-in dimension has eight rows and is broadcast. A caller's own table is joined without
    a hint: its size is unknown here, so Spark's statistics decide.
    """
    if dimension is None:
        dimension = F.broadcast(pair_dimension(rows.sparkSession))
    return rows.join(dimension, ["exchange", "crypto_pair"], "inner")
