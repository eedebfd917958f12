"""Every operator as a named query over the given tables: name -> (spark, folder) -> DataFrame.

Prices leave as DOUBLE and times as zone-free timestamps, so two engines' results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.clock import ts_literal
from ..functions.fixed_point import scale_text
from ..functions.ids import message_id, name_uuid
from ..operators import monitor, parse, spread, throttle, ticks
from ..operators.pairs import to_canonical
from ..operators.relay import to_relay_json
from ..sources import event_views as views
from . import history, store
from .tiers import TIERS, Tier

# The given events are minutes apart, so windows are hours here; size and grace are arguments.
WINDOW = timedelta(hours=1)
GRACE = timedelta(minutes=10)
REFRESH_NOW = datetime(2024, 1, 15, 12, 34)
RETENTION_NOW = datetime(2024, 2, 15, 6)
HISTORY = ("BTCUSDT", datetime(2024, 1, 10), datetime(2024, 1, 27))
LONG_HISTORY = ("ETH-USD", datetime(2024, 1, 1), datetime(2024, 3, 1))
SHORT_HISTORY = ("BTCUSDT", datetime(2024, 1, 10), datetime(2024, 1, 10, 12))


def _plain(rows: DataFrame) -> DataFrame:
    """DECIMAL to DOUBLE, timestamps to zone-free."""
    changed = []
    for name, kind in rows.dtypes:
        column = F.col(name)
        if kind.startswith("decimal"):
            column = column.cast("double").alias(name)
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz").alias(name)
        changed.append(column)
    return rows.select(*changed)


def _mean(name: str) -> Column:
    """A mean to six places: engines differ in how many digits one keeps. The nudge takes exact halves
    off the edge, where a decimal and a binary mean would round apart."""
    return F.round(F.col(name).cast("double") + 1e-9, 6)


def _points(rows: DataFrame) -> DataFrame:
    """Means to six places, and the exact sums they come from as text."""
    return _plain(rows.withColumns({"avg_price": _mean("avg_price"), "price_sum": F.col("price_sum").cast("string")}))


def _ticks(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    return ticks.to_ticks(views.quotes(spark, sf_dir), keep, time=F.col("ts"))


# -- parsing -----------------------------------------------------------------------------------


def raw_parse_outcomes(spark, sf_dir):
    parsed = [
        parse.parse_binance(views.binance_raw(spark, sf_dir)),
        parse.parse_coinbase(views.coinbase_raw(spark, sf_dir)),
    ]
    counts = [
        p.groupBy("exchange", "outcome", F.coalesce("reason", F.lit("")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("messages")) for p in parsed
    ]
    return counts[0].unionByName(counts[1])


def binance_parse(spark, sf_dir):
    parsed = parse.parse_binance(views.binance_raw(spark, sf_dir))
    return parse.tickers(parsed).select(
        "event_id", *(c for c in parse.BINANCE_TICKER_COLUMNS),
    )


def coinbase_parse(spark, sf_dir):
    parsed = parse.parse_coinbase(views.coinbase_raw(spark, sf_dir))
    return parse.tickers(parsed).select("event_id", *parse.COINBASE_TICKER_COLUMNS)


def dead_letters(spark, sf_dir):
    outputs = [
        parse.dead_letters(parse.parse_binance(views.binance_raw(spark, sf_dir))),
        parse.dead_letters(parse.parse_coinbase(views.coinbase_raw(spark, sf_dir))),
    ]
    rows = [o.select("event_id", "exchange", "raw", "reason") for o in outputs]
    return rows[0].unionByName(rows[1])


def dead_letter_replay(spark, sf_dir):
    """All dead letters again, after the unreadable number among them was put right in the stored text."""
    replays = []
    for exchange, raw in (("binance", views.binance_raw(spark, sf_dir)), ("coinbase", views.coinbase_raw(spark, sf_dir))):
        letters = parse.dead_letters(parse.parser_of(exchange)(raw)).select(*raw.columns)
        letters = letters.withColumn("raw", F.replace("raw", F.lit('"x"'), F.lit('"1"')))
        replays.append(parse.replay_dead_letters(letters, exchange).select("event_id", "exchange", "status", "level", "message"))
    return replays[0].unionByName(replays[1])


def fixed_point_scale(spark, sf_dir):
    value = F.col("value").cast("decimal(18,9)").cast("string")
    user = F.col("user_id").cast("string")
    text = (
        F.when(F.col("event_type") == "view", value)
        .when(F.col("event_type") == "click", F.concat(F.lit("-"), value))
        .when(F.col("event_type") == "purchase", F.concat(user, F.lit("e-3")))
        .when(F.col("event_type") == "error", F.concat(F.lit(" "), value))
        .otherwise(F.concat(user, F.lit("x")))
    )
    # every fifth text is long: digits far behind the point that an exponent brings before it
    lead, tail = (F.col("event_id") % 9).cast("string"), F.lpad(user, 9, "0")
    text = (
        F.when(F.col("event_id") % 15 == 0, F.concat(lead, F.lit("."), tail, tail, F.lit("1234567890123456789e10")))
        .when(F.col("event_id") % 15 == 5, F.concat(F.lit("0.000000000000000001"), tail, F.lit("E18")))
        .when(F.col("event_id") % 15 == 10, F.concat(F.lit("-"), user, tail, F.lit("0000000000000000000000.5e-24")))
        .otherwise(text)
    )
    return views.events(spark, sf_dir).select("event_id", text.alias("text")).select(
        "event_id", "text",
        F.coalesce(scale_text(F.col("text"), 8), F.lit(-1)).alias("scaled_8"),
        F.coalesce(scale_text(F.col("text"), 2), F.lit(-1)).alias("scaled_2"),
    )


def message_ids(spark, sf_dir):
    return views.quotes(spark, sf_dir).select(
        "event_id",
        message_id(F.col("event_id"), F.col("crypto_pair"), F.col("best_bid")).alias("binance_style"),
        message_id(F.col("timestamp"), F.col("crypto_pair"), F.col("price_scale") + F.lit(0.5)).alias("coinbase_style"),
        name_uuid(F.col("message_id")).alias("plain"),
    )


def ingest_audit(spark, sf_dir):
    outputs = [
        parse.ingest_audit(parse.parse_binance(views.binance_raw(spark, sf_dir)), key="event_id"),
        parse.ingest_audit(parse.parse_coinbase(views.coinbase_raw(spark, sf_dir)), key="event_id"),
    ]
    return outputs[0].unionByName(outputs[1]).select("message", "messageId", "level", "serviceName", "timestamp")


# -- pairs, windows, spreads -------------------------------------------------------------------


def canonical_ticks(spark, sf_dir):
    return to_canonical(views.quotes(spark, sf_dir)).select("event_id", "exchange", "crypto_pair", "canonical_pair")


def _slim_quotes(spark, sf_dir):
    return views.quotes(spark, sf_dir).select(
        "exchange", "crypto_pair", "event_id", "ts", "arrival", "best_bid", "best_ask"
    )


def latest_per_pair(spark, sf_dir):
    return _plain(throttle.latest_per_key(_slim_quotes(spark, sf_dir), ["exchange", "crypto_pair"]).drop("arrival"))


def throttle_latest(spark, sf_dir):
    return _plain(throttle.throttle_latest(_slim_quotes(spark, sf_dir), WINDOW, GRACE).drop("arrival"))


def throttle_closed(spark, sf_dir):
    return _plain(throttle.throttle_closed(_slim_quotes(spark, sf_dir), WINDOW, GRACE).drop("arrival"))


def late_ticks(spark, sf_dir):
    late = throttle.late_rows(_slim_quotes(spark, sf_dir), WINDOW, GRACE)
    return _plain(late.select("event_id", "exchange", "crypto_pair", "ts"))


def late_ticks_lanes(spark, sf_dir):
    """Late rows of feeds with three lanes each, whose positions start over and collide."""
    rows = views.laned_quotes(spark, sf_dir).withColumn("feed", F.concat_ws("/", "exchange", "lane"))
    late = throttle.late_rows(rows.select("feed", "event_id", "ts", "arrival"), WINDOW, GRACE, lane="feed")
    return _plain(late.select("event_id", "feed", "ts"))


def spread_changelog_lanes(spark, sf_dir):
    """Spreads across topics: by record time, then exchange, lane and position in the lane."""
    return spread.spread_changelog_by_time(
        to_canonical(views.laned_quotes(spark, sf_dir)), keep=["event_id"], carry=["event_id"]
    )


def spread_snapshot(spark, sf_dir):
    return spread.spread_snapshot(to_canonical(views.quotes(spark, sf_dir)), carry=["event_id"])


def spread_changelog(spark, sf_dir):
    return spread.spread_changelog(
        to_canonical(views.quotes(spark, sf_dir)), keep=["event_id"], carry=["event_id"]
    )


# -- ticks -------------------------------------------------------------------------------------


def ticks_normalized(spark, sf_dir):
    return _plain(ticks.to_ticks(views.quotes(spark, sf_dir), ["event_id"]))


def ticks_mapping_errors(spark, sf_dir):
    return ticks.mapping_errors(views.faulty_quotes(spark, sf_dir), ["event_id"])


def ticks_dedupe(spark, sf_dir):
    """Delivered ticks, some twice, down to the first copy of each."""
    delivered = views.redelivered(_ticks(spark, sf_dir, ["event_id", "arrival"]))
    return _plain(ticks.first_copies(delivered).drop("arrival"))


def ticks_idempotent_append(spark, sf_dir):
    """What a batch of every delivered tick adds to a table that already holds the Coinbase ones."""
    delivered = views.redelivered(_ticks(spark, sf_dir, ["event_id", "arrival"]))
    stored = _ticks(spark, sf_dir).filter(F.col("exchange") == "coinbase")
    return _plain(ticks.new_ticks(delivered, stored).drop("arrival"))


# -- roll-ups ----------------------------------------------------------------------------------


def _tier(spark, sf_dir, name: str, rows: Callable[[DataFrame], DataFrame] = lambda r: r) -> DataFrame:
    """A tier built from ticks through its whole chain; ``rows`` narrows the ticks at the bottom."""
    tier = TIERS[name]
    source = rows(_ticks(spark, sf_dir)) if tier.source == "ticks" else _tier(spark, sf_dir, tier.source, rows)
    return tier.build(source)


def _tier_query(name: str):
    def query(spark, sf_dir):
        return _points(_tier(spark, sf_dir, name))

    return query


def _refresh_query(name: str):
    """The points a refresh at a fixed time would write. Only ticks of its range are read."""

    def query(spark, sf_dir):
        start, end = TIERS[name].refresh_range(REFRESH_NOW)

        def in_range(rows):
            like = dict(rows.dtypes)["time"]
            return rows.filter(ticks.within(F.col("time"), ts_literal(start, like), ts_literal(end, like)))

        return _points(_tier(spark, sf_dir, name, in_range))

    return query


def retention_filter(spark, sf_dir):
    kept = store.retained(_ticks(spark, sf_dir, ["event_id"]), RETENTION_NOW)
    return _plain(kept.select("event_id", "time", "exchange", "crypto_pair", "price"))


def _history(spark, sf_dir, request, exchange=None):
    def read_tier(tier: Tier, start: datetime, end: datetime) -> DataFrame:
        """The tier of the given ticks, built only over the buckets asked for."""

        def in_range(rows):
            like = dict(rows.dtypes)["time"]
            return rows.filter(ticks.within(
                F.col("time"), ts_literal(tier.floor(start), like), ts_literal(tier.floor(end) + tier.bucket, like)
            ))

        return _tier(spark, sf_dir, tier.name, in_range)

    return _points(history.ohlc_history(read_tier, *request, exchange=exchange))


def ohlc_history(spark, sf_dir):
    return _history(spark, sf_dir, HISTORY)


def ohlc_history_exchange(spark, sf_dir):
    return _history(spark, sf_dir, HISTORY, exchange="BINANCE")


def ohlc_history_daily(spark, sf_dir):
    return _history(spark, sf_dir, LONG_HISTORY)


def ohlc_history_minute(spark, sf_dir):
    return _history(spark, sf_dir, SHORT_HISTORY)


def compare_exchanges(spark, sf_dir):
    rows = history.compare_exchanges(_tier(spark, sf_dir, "hourly"))
    averages = {f"{s}_avg_price": _mean(f"{s}_avg_price") for s in history.EXCHANGES}
    return _plain(rows.withColumns(averages))


# -- monitoring and client feed ----------------------------------------------------------------


def monitor_valid(spark, sf_dir):
    events = monitor.read_monitor_json(views.monitor_messages(spark, sf_dir))
    return monitor.valid_monitor(events).select("event_id", "message", "level", "messageId")


def monitor_reshape(spark, sf_dir):
    events = monitor.read_monitor_json(views.monitor_messages(spark, sf_dir))
    lines = monitor.reshape_monitor(events, keep=["event_id"])
    return lines.withColumns({
        "metadata": F.to_json("metadata"), "level": F.coalesce("level", F.lit("")),
        "message": F.coalesce("message", F.lit("")),
    })


def relay_json(spark, sf_dir):
    binance = parse.tickers(parse.parse_binance(views.binance_raw(spark, sf_dir)))
    coinbase = parse.tickers(parse.parse_coinbase(views.coinbase_raw(spark, sf_dir)))
    return to_relay_json(binance, schemas.BINANCE_TICKER, ["event_id", "exchange"]).unionByName(
        to_relay_json(coinbase, schemas.COINBASE_TICKER, ["event_id", "exchange"])
    )


def relay_spread_json(spark, sf_dir):
    """Spread events as client JSON, read back with the declared layout: the fields a client sees."""
    sent = to_relay_json(spread_changelog(spark, sf_dir), schemas.SPREAD_EVENT, ["event_id"])
    return sent.select("event_id", F.from_json("value", schemas.SPREAD_EVENT).alias("m")).select("event_id", "m.*")


_NAMED = [
    raw_parse_outcomes, binance_parse, coinbase_parse, dead_letters, dead_letter_replay, fixed_point_scale,
    message_ids, ingest_audit, canonical_ticks, latest_per_pair, throttle_latest, throttle_closed, late_ticks,
    late_ticks_lanes, spread_snapshot, spread_changelog, spread_changelog_lanes, ticks_normalized, ticks_mapping_errors, ticks_dedupe,
    ticks_idempotent_append, retention_filter, ohlc_history, ohlc_history_exchange, ohlc_history_daily,
    ohlc_history_minute, compare_exchanges, monitor_valid, monitor_reshape, relay_json, relay_spread_json,
]


def _in_utc(query):
    """Buckets and ISO texts are UTC, whatever zone the caller's session has."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {q.__name__: q for q in _NAMED}
    found.update({f"ohlc_{name}": _tier_query(name) for name in TIERS})
    found.update({f"refresh_window_{name}": _refresh_query(name) for name in TIERS if name != "weekly"})
    return {name: _in_utc(query) for name, query in found.items()}
