"""Every record layout, declared once. Nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql import types as T


STRING, LONG, INT, DOUBLE, TIMESTAMP = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType(),
)
PRICE = T.DecimalType(28, 8)
# Wide enough for the mean of any prices the tick table admits.
AVERAGE = T.DecimalType(32, 12)
PRICE_SUM = T.DecimalType(38, 8)


def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# ``arrival`` orders the messages of one ``lane``: a topic partition or a landed file.
RAW_PAYLOAD = _fields(exchange=STRING, raw=STRING, lane=STRING, arrival=LONG, ingest_ts=TIMESTAMP)

BINANCE_TICKER = _fields(
    event_time=LONG, crypto_pair=STRING, best_bid_price=LONG, best_bid_qty=LONG, best_ask_price=LONG,
    best_ask_qty=LONG, volume=LONG, timestamp=STRING, message_id=STRING, price_scale=INT,
)

COINBASE_TICKER = _fields(
    crypto_pair=STRING, best_bid=LONG, best_ask=LONG, price=LONG, best_bid_quantity=LONG,
    best_ask_quantity=LONG, event_time=STRING, timestamp=STRING, message_id=STRING, price_scale=INT,
    quantity_scale=INT,
)

# What both exchanges' tickers become before windows, spreads and the tick table: one layout,
# so every later step is a single plan instead of one per exchange.
QUOTE = _fields(
    exchange=STRING, crypto_pair=STRING, best_bid=LONG, best_ask=LONG, price=LONG, price_scale=INT,
    timestamp=STRING, message_id=STRING, lane=STRING, arrival=LONG, ts=TIMESTAMP,
)

SPREAD_EVENT = _fields(
    crypto_pair=STRING, message_id=STRING, timestamp=STRING,
    binance_best_bid=DOUBLE, binance_best_ask=DOUBLE, coinbase_best_bid=DOUBLE, coinbase_best_ask=DOUBLE,
    spread_buy_binance_sell_coinbase=DOUBLE, spread_buy_coinbase_sell_binance=DOUBLE,
)

TICK = _fields(time=TIMESTAMP, exchange=STRING, crypto_pair=STRING, price=PRICE, message_id=STRING)

OHLC = _fields(
    bucket=TIMESTAMP, exchange=STRING, crypto_pair=STRING, open=PRICE, high=PRICE, low=PRICE, close=PRICE,
    avg_price=AVERAGE, price_sum=PRICE_SUM, tick_count=LONG,
)

MONITOR_EVENT = _fields(
    message=STRING, timestamp=STRING, messageId=STRING, level=STRING, serviceName=STRING,
    instanceId=STRING, traceId=STRING, metadata=T.MapType(STRING, STRING), host=STRING, environment=STRING,
)
