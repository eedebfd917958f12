"""Chunked running values, the late rule and the spread against direct, slow definitions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators.pairs import PAIRS, pair_dimension, to_canonical
from tickloom.operators.running import chunk_of, running
from tickloom.operators.spread import spread_changelog, spread_snapshot
from tickloom.operators.throttle import drop_late, late_rows, latest_per_key, throttle_closed, throttle_latest
from tickloom.plans.registry import all_queries
from tickloom.sources import event_views as views

QUERIES = all_queries()

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("span,group", [(1, 1024), (1, 4), (3, 2), (7, 1), (1000, 5)])
def test_running_equals_plain_window(spark, span, group):
    rng = random.Random(span)
    rows = [(f"k{min(rng.randrange(6), 2)}", i, rng.choice([None, rng.randrange(100)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, n bigint, v bigint").repartition(5)
    got = running(df, ["k"], ["n"], chunk_of("n", span), {
        "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "la": ("last", F.col("v")),
    }, group)
    w = Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "n", "v", F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"),
                     F.last("v", True).over(w).alias("la"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def feed(seed, n=400, lanes=("binance", "coinbase")):
    """Out-of-order deliveries; one lane and one pair hold most rows."""
    rng = random.Random(seed)
    rows, clock = [], 0
    for i in range(n):
        clock += rng.choice([0, 50, 100, 400])
        at = max(0, clock - rng.choice([0, 0, 0, 300, 900, 1500, 2600, 6000]))
        lane = lanes[0] if rng.random() < 0.7 else lanes[1]
        rows.append((lane, rng.choice(["A", "A", "A", "B"]), T0 + timedelta(milliseconds=at), i, f"m{i}"))
    return rows


def brute_late(rows, size, grace):
    seen, late = {}, set()
    for lane, _, ts, arrival, _ in sorted(rows, key=lambda r: r[3]):
        seen[lane] = max(seen.get(lane, ts), ts)
        start = T0 + ((ts - T0) // size) * size
        if start + size + grace <= seen[lane]:
            late.add(arrival)
    return late, seen


@pytest.mark.parametrize("size_ms,grace_ms", [(500, 1000), (500, 300), (1000, 0), (1000, 700)])
def test_late_rule_equals_brute_force(spark, size_ms, grace_ms):
    size, grace = timedelta(milliseconds=size_ms), timedelta(milliseconds=grace_ms)
    rows = feed(size_ms + grace_ms)
    df = spark.createDataFrame(rows, "exchange string, crypto_pair string, ts timestamp_ntz, arrival bigint, m string").repartition(4)
    late, clock = brute_late(rows, size, grace)
    assert late, "the fixture must contain late rows"
    assert {r.arrival for r in late_rows(df, size, grace).collect()} == late
    assert drop_late(df, size, grace).count() == len(rows) - len(late)

    last = {}
    for lane, pair, ts, arrival, m in sorted(rows, key=lambda r: r[3]):
        if arrival not in late:
            last[(lane, pair, T0 + ((ts - T0) // size) * size)] = m
    got = {(r.exchange, r.crypto_pair, r.window_start): r.m for r in throttle_latest(df, size, grace).collect()}
    assert got == last
    closed = {k: m for k, m in last.items() if k[2] + size + grace <= clock[k[0]]}
    got = {(r.exchange, r.crypto_pair, r.window_start): r.m for r in throttle_closed(df, size, grace).collect()}
    assert got == closed


def quote_rows(n=200, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        exchange, pair, _ = rng.choice(PAIRS[:1] * 4 + PAIRS + [("binance", "DOGEUSDT", "")])
        price = rng.randrange(1, 10**6)
        out.append((exchange, pair, price, price + 3, 8 if exchange == "binance" else 2, f"id{i}",
                    f"2024-01-01T00:00:{i % 60:02d}.000000Z", i))
    return out


QUOTES = "exchange string, crypto_pair string, best_bid bigint, best_ask bigint, price_scale int, message_id string, timestamp string, arrival bigint"


@pytest.mark.parametrize("span", [1, 9, 10**6])
def test_changelog_equals_replay(spark, span):
    rows = quote_rows()
    canonical = {(e, p): c for e, p, c in PAIRS}
    state, want = {}, []
    for r in rows:
        pair = canonical.get((r[0], r[1]))
        if pair is None:
            continue
        state.setdefault(pair, {})[r[0]] = r
        both = state[pair]
        if len(both) == 2:
            b, c = both["binance"], both["coinbase"]
            want.append((r[7], pair, round(c[2] / 100 - b[3] / 1e8, 6), round(b[2] / 1e8 - c[3] / 100, 6)))
    df = to_canonical(spark.createDataFrame(rows, QUOTES).repartition(3))
    got = spread_changelog(df, chunk=chunk_of("arrival", span), keep=["arrival"])
    assert sorted(
        (r.arrival, r.crypto_pair, round(r.spread_buy_binance_sell_coinbase, 6), round(r.spread_buy_coinbase_sell_binance, 6))
        for r in got.collect()
    ) == sorted(want)
    final = {r.crypto_pair: r.message_id for r in spread_snapshot(df).collect()}
    last = {}
    for r in got.orderBy("arrival").collect():
        last[r.crypto_pair] = r.message_id
    assert final == last


def test_own_dimension_and_unlisted_pairs(spark):
    df = spark.createDataFrame(quote_rows(), QUOTES)
    assert to_canonical(df).filter(F.col("crypto_pair") == "DOGEUSDT").count() == 0
    dim = pair_dimension(spark).union(spark.createDataFrame([("binance", "DOGEUSDT", "DOGE-USDT")]))
    assert to_canonical(df, dim).filter(F.col("crypto_pair") == "DOGEUSDT").count() > 0


def test_plans_keep_raw_rows_in_place(spark, sf_dir):
    """The late filter broadcasts a counted table, so raw rows meet their first shuffle after partial
    aggregation; no plan gathers rows into a single partition."""
    from tickloom.plans.registry import all_queries

    for name in ("throttle_latest", "spread_changelog", "ohlc_hourly", "ticks_idempotent_append"):
        plan = all_queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "CartesianProduct" not in plan, name
        if name == "throttle_latest":
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_latest_rows_are_hashed_not_sorted(spark, sf_dir):
    """Fixed-width rows stay in the aggregation; texts are joined back from the winners alone."""
    quotes = views.quotes(spark, sf_dir)
    for columns in (["best_bid", "best_ask", "ts"], ["best_bid", "message_id", "timestamp"]):
        rows = quotes.select("exchange", "crypto_pair", "arrival", *columns)
        last = latest_per_key(rows, ["exchange", "crypto_pair"])
        assert "HashAggregate" in _plan(last) and "SortAggregate" not in _plan(last)
        top = {(r.exchange, r.crypto_pair): r.m for r in rows.groupBy("exchange", "crypto_pair").agg(F.max("arrival").alias("m")).collect()}
        assert {(r.exchange, r.crypto_pair): r.arrival for r in last.collect()} == top


def test_dedupe_shuffles_once(spark, sf_dir):
    plan = _plan(QUERIES["ticks_dedupe"](spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan and "Aggregate" not in plan


def test_closed_windows_need_one_row_per_lane(spark, sf_dir):
    plan = _plan(QUERIES["throttle_closed"](spark, sf_dir))
    assert plan.count("FileScan parquet") == 1 and "BroadcastExchange" in plan


def test_a_burst_is_spread_over_bounded_chunks(spark, sf_dir):
    """A third of all rows within one minute, some of them at one moment: chunks stay bounded and the result the same."""
    from tickloom.operators.spread import spread_changelog_by_time, with_time_chunks

    rows = to_canonical(views.laned_quotes(spark, sf_dir)).select(
        "exchange", "canonical_pair", "best_bid", "best_ask", "price_scale", "message_id", "timestamp", "lane", "arrival", "ts")
    first = F.lit("2024-01-09 10:00:00").cast("timestamp_ntz")
    burst = F.pmod(F.xxhash64("message_id"), F.lit(3)) == 0
    inside = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.pmod(F.xxhash64("arrival"), F.lit(60_000)) / 1000).cast("decimal(18,6)"))
    rows = rows.withColumn("ts", F.when(burst, first + inside).otherwise(F.col("ts").cast("timestamp_ntz"))).persist()
    sizes = with_time_chunks(rows, ["canonical_pair"], most=50).groupBy("canonical_pair", "_time_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 50 and sizes.agg(F.sum("count")).first()[0] == rows.count()
    assert with_time_chunks(rows, ["canonical_pair"], most=10**9).groupBy("canonical_pair", "_time_chunk").count() \
        .agg(F.max("count")).first()[0] > rows.count() / 20
    few, many = (spread_changelog_by_time(rows, keep=["arrival", "exchange", "lane"], most=n) for n in (50, 10**9))
    assert few.count() == many.count() and few.exceptAll(many).count() == 0
