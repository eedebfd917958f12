"""Every named query against SQL run by another engine on the same files."""

import pytest
from compare import difference, duck

from tickloom.plans.oracles import all_oracles
from tickloom.plans.registry import all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


def test_names_agree():
    assert set(ORACLES) == set(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


# Counts and sums worked out ahead of the build.
GOLDEN_COUNTS = {
    "late_ticks": 917, "throttle_latest": 5217, "throttle_closed": 5208, "ohlc_hourly": 5525, "ohlc_daily": 300,
    "ohlc_minute": 9981, "ohlc_30min": 7434, "ohlc_weekly": 50, "spread_changelog": 7976,
    "refresh_window_hourly": 14, "retention_filter": 5332, "ohlc_history": 327, "compare_exchanges": 1724,
    "ticks_dedupe": 10000, "binance_parse": 9412, "relay_spread_json": 7976,
}


@pytest.mark.parametrize("name", sorted(GOLDEN_COUNTS))
def test_golden_count(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() == GOLDEN_COUNTS[name]


def test_golden_spreads(spark, sf_dir):
    rows = {r.crypto_pair: r for r in QUERIES["spread_snapshot"](spark, sf_dir).collect()}
    assert rows["BTC-USDT"].spread_buy_binance_sell_coinbase == 183.04499999
    assert rows["ETH-USDT"].spread_buy_coinbase_sell_binance == -10.075
    assert rows["XRP-USDT"].spread_buy_binance_sell_coinbase == 36.41499999
