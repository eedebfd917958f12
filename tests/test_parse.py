"""The outcome of every message shape the two feeds are told apart by."""

import json

import pytest
from pyspark.sql import functions as F

from tickloom.operators import parse


def binance(**changes):
    body = {"e": "24hrTicker", "E": 123, "s": "BTCUSDT", "b": "1.5", "B": "2", "a": "1.6", "A": "3", "v": "10"}
    body.update(changes)
    return json.dumps({k: v for k, v in body.items() if v is not ...})


def coinbase(tickers=None, **changes):
    ticker = {"product_id": "ETH-USD", "price": "10.129", "volume_24_h": "12345678.9", "best_bid": "10.1",
              "best_ask": "10.2", "best_bid_quantity": "0.5", "best_ask_quantity": "0.25"}
    ticker.update(changes)
    ticker = {k: v for k, v in ticker.items() if v is not ...}
    return json.dumps({"timestamp": "T1", "events": [{"tickers": [ticker] if tickers is None else tickers}]})


BINANCE = [
    (binance(), "ok"), (None, "ignored"), ("", "ignored"), (" \n", "ignored"), ('{"result":null,"id":1}', "ignored"),
    ("[1,2]", "ignored"), ("7", "ignored"), ("null", "ignored"), (binance(e=None), "ok"), (binance(e=...), "ignored"),
    ("{bad", "dead_letter"), ("{'e':1}", "dead_letter"), (binance(s=...), "dead_letter"), (binance(v=...), "dead_letter"),
    (binance(E=...), "dead_letter"), (binance(b="x"), "dead_letter"), (binance(b=None), "dead_letter"),
    (binance(b=" 1"), "dead_letter"), (binance(b={}), "dead_letter"), (binance(E="zz"), "ok"), (binance(E=None), "ok"),
    (binance(s=None), "ok"), (binance(b=1.5), "ok"), (binance(b="1e400"), "dead_letter"), (binance() + " tail", "ok"),
    (binance(x=[1, {"b": 2}]), "ok"),
]
COINBASE = [
    (coinbase(), "ok"), (None, "ignored"), ("", "ignored"), ('{"type":"subscriptions"}', "ignored"),
    ('{"events":null}', "dead_letter"), ('{"events":[]}', "dead_letter"), ('{"events":{}}', "dead_letter"),
    ('{"timestamp":"T","events":[{"type":"x"}]}', "ignored"), ('{"events":[null]}', "ignored"), (coinbase([]), "dead_letter"),
    ('{"events":[{"tickers":null}]}', "dead_letter"), (coinbase([5]), "dead_letter"), (coinbase(price=...), "dead_letter"),
    (coinbase(best_ask="x"), "dead_letter"), (coinbase(volume_24_h="n/a"), "ok"), (coinbase(volume_24_h=None), "ok"),
    (coinbase(volume_24_h=...), "dead_letter"), (coinbase(product_id=...), "dead_letter"), ("{bad", "dead_letter"),
    (coinbase().replace('"timestamp": "T1"', '"time": "T1"'), "dead_letter"),
    (coinbase()[:-2] + ', 5]}', "ok"), (coinbase().replace('}]}]}', '}, {"product_id": 1}]}]}'), "ok"),
]


def run(spark, messages, exchange):
    rows = [(exchange, m, i) for i, m in enumerate(messages)]
    raw = spark.createDataFrame(rows, "exchange string, raw string, arrival bigint").withColumn(
        "ingest_ts", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    return parse.parser_of(exchange)(raw)


@pytest.mark.parametrize("exchange,cases", [("binance", BINANCE), ("coinbase", COINBASE)])
def test_outcomes(spark, exchange, cases):
    got = {r.arrival: r.outcome for r in run(spark, [m for m, _ in cases], exchange).collect()}
    assert [(m, got[i]) for i, (m, _) in enumerate(cases)] == cases


def test_values(spark):
    b = run(spark, [binance(E="zz"), binance(s=None), binance(s={"a": 1}), binance(b=1.5, E=7.9)], "binance").orderBy("arrival").collect()
    assert [r.event_time for r in b] == [0, 123, 123, 7]
    assert [r.crypto_pair for r in b] == ["BTCUSDT", "null", "", "BTCUSDT"]
    assert b[3].best_bid_price == 150000000 and b[0].volume == 1000000000 and b[0].best_ask_qty == 300000000
    c = run(spark, [coinbase(), coinbase(volume_24_h="n/a")], "coinbase").orderBy("arrival").collect()
    assert (c[0].price, c[0].best_bid, c[0].best_bid_quantity) == (1012, 1010, 50000000)
    assert (c[0].price_scale, c[0].quantity_scale, c[0].event_time) == (2, 8, "T1")
    assert c[1].volume == 0.0


def test_coinbase_id_uses_double_text(spark):
    import hashlib
    import uuid

    row = run(spark, [coinbase()], "coinbase").first()
    digest = hashlib.md5(b"T1|ETH-USD|1.23456789E7").digest()
    assert row.message_id == str(uuid.UUID(bytes=digest, version=3))


def test_replay_and_audit(spark):
    raw = run(spark, [binance(), '{"id":1}', "{bad"], "binance").select("exchange", "raw", "arrival", "ingest_ts")
    replay = parse.replay_dead_letters(raw, "binance").orderBy("arrival").collect()
    assert [r.status for r in replay] == ["republished", "invalid", "failed_again"]
    assert replay[0].message == "[DLT] Successfully republished message with id " + replay[0].message_id
    assert replay[1].message == '[DLT] Problem with republished message: {"id":1}'
    result = parse.parse_raw(raw, "binance")
    audit = result.audit.orderBy("level").collect()
    assert [a.level for a in audit] == ["ERROR", "INFO"]
    assert audit[0].message == "BinanceError: malformed JSON" and audit[1].message.startswith("Binance Published message ")
    assert result.audit.collect() == result.audit.collect()
    assert (result.ok.count(), result.ignored.count(), result.dead_letters.count()) == (1, 1, 1)


def test_unknown_exchange():
    with pytest.raises(ValueError):
        parse.parser_of("kraken")
