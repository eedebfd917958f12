"""The given ``events`` table seen as exchange feeds.

Each view is a projection of the whole table, row by row, so it costs one scan at any size.
``arrival`` is the position in a slightly shuffled delivery order: rows sort by
``event_id + jitter`` and then ``event_id``. Packing that pair into one number gives the same order
as ranking every row, without a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import iso_text

_JITTER = 11


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _arrival() -> Column:
    jitter = F.pmod(F.col("event_id") * 37, F.lit(_JITTER))
    return (F.col("event_id") + jitter) * _JITTER + (_JITTER - 1) - jitter


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-point quotes of both exchanges. Binance sums are odd, to meet the half-way rounding."""
    user = F.col("user_id") % 4
    binance = F.col("event_id") % 2 == 0
    cents = F.round(F.col("value") * 100).cast("bigint")
    unlisted = F.col("event_type") == "signup"
    pair = (
        F.when(unlisted & binance, "DOGEUSDT")
        .when(unlisted, "DOGE-USD")
        .when(binance & (user == 0), "BTCUSDT")
        .when(binance & (user == 1), "ETHUSDT")
        .when(binance & (user == 2), "SOLUSDT")
        .when(binance, "XRPUSDT")
        .when(user == 0, "BTC-USDT")
        .when(user == 1, "ETH-USD")
        .when(user == 2, "SOL-USD")
        .otherwise("XRP-USD")
    )
    return events(spark, sf_dir).select(
        "event_id",
        "ts",
        _arrival().alias("arrival"),
        F.when(binance, "binance").otherwise("coinbase").alias("exchange"),
        pair.alias("crypto_pair"),
        F.when(binance, cents * 1_000_000 - 500_000).otherwise(cents - 1).alias("best_bid"),
        F.when(binance, cents * 1_000_000 + 500_001).otherwise(cents + 1).alias("best_ask"),
        F.when(~binance, cents).alias("price"),
        F.when(binance, 8).otherwise(2).alias("price_scale"),
        iso_text(F.col("ts")).alias("timestamp"),
        F.md5(F.col("event_id").cast("string")).alias("message_id"),
        F.lit("0").alias("lane"),
    )


def laned_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quotes`` dealt to three lanes per exchange. Each lane counts its positions from the start, so the same
    position stands in every lane, and delivery in a lane is slightly shuffled."""
    step = F.expr("event_id div 6")
    jitter = F.pmod(F.col("event_id") * 37, F.lit(_JITTER))
    return quotes(spark, sf_dir).withColumns({
        "lane": F.expr("event_id div 2 % 3").cast("string"), "arrival": (step + jitter) * _JITTER + (_JITTER - 1) - jitter,
    })


def faulty_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quotes`` where some rows carry an unreadable time or a negative scale."""
    return quotes(spark, sf_dir).withColumns({
        "timestamp": F.when(F.col("event_id") % 97 == 0, F.lit("yesterday"))
        .when(F.col("event_id") % 89 == 0, F.regexp_replace("timestamp", "Z$", ""))
        .otherwise(F.col("timestamp")),
        "price_scale": F.when(F.col("event_id") % 83 == 0, F.lit(-1)).otherwise(F.col("price_scale")),
    })


def redelivered(ticks: DataFrame) -> DataFrame:
    """Every row, and every tenth one delivered a second time later on."""
    copies = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return ticks.withColumn("copy", F.explode(copies)).withColumn(
        "arrival", F.col("arrival") * 2 + F.col("copy")
    ).drop("copy")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def binance_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Binance message per row: full tickers, acknowledgements, and several broken shapes."""
    eid = F.col("event_id")
    value = F.col("value").cast("decimal(18,9)").cast("string")
    ticker = F.concat(
        F.lit('{"e":"24hrTicker","E":'), _text("event_id"), F.lit(',"s":"BTCUSDT","b":"'), value,
        F.lit('","B":"1.5","a":"'), value, F.lit('","A":"2.5","v":"'), _text("user_id"), F.lit('"}'),
    )
    raw = (
        F.when(eid % 97 == 0, F.lit("{bad"))
        .when(eid % 89 == 0, F.lit('{"result":null,"id":1}'))
        .when(eid % 83 == 0, F.concat(F.lit('{"e":"24hrTicker","E":'), _text("event_id"), F.lit(',"s":"BTCUSDT"}')))
        .when(eid % 79 == 0, F.lit(""))
        .when(eid % 73 == 0, F.lit('{"e":"24hrTicker","E":1,"s":"BTCUSDT","b":"x","B":"1","a":"1","A":"1","v":"1"}'))
        .otherwise(ticker)
    )
    return events(spark, sf_dir).select(
        "event_id", F.lit("binance").alias("exchange"), raw.alias("raw"), (eid % 3).cast("string").alias("lane"),
        _arrival().alias("arrival"), F.col("ts").alias("ingest_ts"), "event_type",
    )


def coinbase_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Coinbase message per row, with every shape the parser tells apart."""
    eid = F.col("event_id")
    value = F.col("value").cast("decimal(18,9)").cast("string")
    stamp = F.concat(F.lit('{"timestamp":"T'), _text("event_id"), F.lit('",'))

    def full(volume: Column, ask: Column | None = None) -> Column:
        ask_part = [F.lit('"best_ask":"'), value, F.lit('",')] if ask is None else [ask]
        return F.concat(
            F.lit('{"product_id":"ETH-USD","price":"'), value, F.lit('","volume_24_h":'), volume,
            F.lit(',"best_bid":"'), value, F.lit('",'), *ask_part,
            F.lit('"best_bid_quantity":"0.5","best_ask_quantity":"0.25"}'),
        )

    def message(tickers: Column) -> Column:
        return F.concat(stamp, F.lit('"events":[{"type":"update","tickers":'), tickers, F.lit("}]}"))

    volume = F.concat(F.lit('"'), _text("user_id"), F.lit('.5"'))
    usual = full(volume)
    raw = (
        F.when(eid % 97 == 0, F.lit("{bad"))
        .when(eid % 89 == 0, F.lit('{"type":"subscriptions","channel":"ticker"}'))
        .when(eid % 83 == 0, F.concat(stamp, F.lit('"events":[]}')))
        .when(eid % 79 == 0, F.lit(""))
        .when(eid % 73 == 0, F.concat(stamp, F.lit('"events":[{"type":"snapshot"}]}')))
        .when(eid % 71 == 0, message(F.lit("[]")))
        .when(eid % 67 == 0, F.concat(stamp, F.lit('"events":null}')))
        .when(eid % 61 == 0, message(F.concat(
            F.lit("["), full(volume, F.lit('"best_ask":"x",')), F.lit("]"))))
        .when(eid % 59 == 0, message(F.concat(F.lit("["), full(F.lit('"n/a"')), F.lit("]"))))
        .when(eid % 53 == 0, message(F.concat(F.lit("["), usual, F.lit(',{"product_id":"LATER"}]'))))
        .when(eid % 47 == 0, message(F.concat(F.lit("["), full(volume, F.lit("")), F.lit("]"))))
        .otherwise(message(F.concat(F.lit("["), usual, F.lit("]"))))
    )
    return events(spark, sf_dir).select(
        "event_id", F.lit("coinbase").alias("exchange"), raw.alias("raw"), (eid % 3).cast("string").alias("lane"),
        _arrival().alias("arrival"), F.col("ts").alias("ingest_ts"), "event_type",
    )


def monitor_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One monitoring event per row as JSON text; some lack a message or a level."""
    eid = F.col("event_id")
    body = F.struct(
        F.when(eid % 23 != 0, F.concat(F.lit("seen "), F.col("event_type"))).otherwise(F.lit("")).alias("message"),
        iso_text(F.col("ts")).alias("timestamp"),
        F.md5(_text("event_id")).alias("messageId"),
        F.when(eid % 29 == 0, F.lit(None).cast("string"))
        .when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("level"),
        F.when(eid % 2 == 0, F.lit("ingestor")).otherwise(F.lit("aggregations")).alias("serviceName"),
        F.concat(F.lit("i-"), F.col("user_id") % 8).alias("instanceId"),
        F.md5(_text("user_id")).alias("traceId"),
        F.create_map(F.lit("kind"), F.col("event_type")).alias("metadata"),
        F.concat(F.lit("host-"), F.col("user_id") % 4).alias("host"),
        F.lit("prod").alias("environment"),
    )
    return events(spark, sf_dir).select("event_id", F.to_json(body).alias("value"))
