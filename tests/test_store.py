"""Tables on disk: appends, refreshes, retention, history."""

from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom.operators.ohlc import ohlc_from_tier, ohlc_from_ticks
from tickloom.plans.changes import STATE
from tickloom.plans.history import compare_exchanges, normalize_exchange, ohlc_history
from tickloom.plans.registry import _ticks
from tickloom.plans.store import TickStore, retention_cutoff
from tickloom.plans.tiers import CHART_TIERS, DAY, HOUR, TIERS, check_policy, refresh_order, select_tier


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


@pytest.fixture
def ticks(spark, sf_dir):
    return _ticks(spark, sf_dir, ["arrival"]).withColumn("time", F.col("time").cast("timestamp"))


@pytest.fixture
def store(spark, tmp_path):
    return TickStore(spark, str(tmp_path / "db"))


def test_append_twice_is_append_once(store, ticks):
    some = ticks.filter(F.col("time") < "2024-01-04")
    store.append_ticks(some.unionByName(some))
    first = store.read_ticks().count()
    assert first == some.count()
    store.append_ticks(some)
    assert store.read_ticks().count() == first
    store.append_ticks(some.limit(0))
    again = some.withColumn("time", F.col("time") + F.expr("interval 1 second")).limit(5)
    store.append_ticks(again)
    assert store.read_ticks().count() == first + 5


def test_layout_prunes_days_and_pairs(store, ticks):
    store.append_ticks(ticks)
    picked = store.read_ticks(utc(2024, 1, 5), utc(2024, 1, 6), "BTCUSDT")
    want = ticks.filter((F.col("time") >= "2024-01-05") & (F.col("time") < "2024-01-06") & (F.col("crypto_pair") == "BTCUSDT"))
    assert picked.count() == want.count() > 0
    folders = {"/".join(f.split("/")[-3:-1]) for f in store.read_ticks().inputFiles()}
    assert len({f.split("/")[0] for f in folders}) == 30
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "pair_bucket" in plan


def test_refresh_builds_only_its_range(store, ticks):
    store.append_ticks(ticks)
    now = utc(2024, 1, 15, 12, 34)
    assert store.refresh_rollup("hourly", now) == (utc(2024, 1, 15, 10), utc(2024, 1, 15, 12))
    points = store.read_tier(TIERS["hourly"])
    assert points.count() == 14 and points.agg(F.sum("tick_count")).first()[0] == 28
    store.refresh_rollup("hourly", now + timedelta(hours=2))
    whole = ohlc_from_ticks(ticks, HOUR).filter((F.col("bucket") >= "2024-01-15 10:00:00") & (F.col("bucket") < "2024-01-15 14:00:00"))
    got = store.read_tier(TIERS["hourly"])
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*got.columns).collect()))


def test_late_data_behind_the_range_is_not_picked_up(store, ticks):
    day = ticks.filter(F.to_date("time") == date(2024, 1, 15))
    store.append_ticks(day.filter(F.col("time") >= "2024-01-15 10:30:00"))
    store.refresh_rollup("hourly", utc(2024, 1, 15, 12, 34))
    before = store.read_tier(TIERS["hourly"]).collect()
    store.append_ticks(day)
    store.refresh_rollup("hourly", utc(2024, 1, 15, 15, 34))
    ten = [r for r in store.read_tier(TIERS["hourly"]).collect() if r.bucket == datetime(2024, 1, 15, 10)]
    assert ten == [r for r in before if r.bucket == datetime(2024, 1, 15, 10)] != []


def test_rebuilt_tiers_agree_with_ticks_and_serve_history(store, ticks):
    store.append_ticks(ticks)
    for name in refresh_order():
        start, end = (utc(2023, 12, 25), utc(2024, 2, 5)) if name == "weekly" else (utc(2024, 1, 1), utc(2024, 2, 1))
        store.rebuild_tier(name, start, end)
    daily = store.read_tier(TIERS["daily"])
    direct = ohlc_from_ticks(ticks, DAY)
    pairs = daily.alias("a").join(direct.alias("b"), ["bucket", "exchange", "crypto_pair"])
    same = pairs.filter(" AND ".join(f"a.{c} = b.{c}" for c in ("open", "high", "low", "close", "tick_count")) + " AND abs(a.avg_price - b.avg_price) < 1e-8")
    assert daily.count() == direct.count() == same.count() == 300
    bad = daily.filter("low > open or low > close or high < open or high < close or avg_price < low - 1e-8 or avg_price > high + 1e-8")
    assert bad.count() == 0
    assert store.read_tier(TIERS["weekly"]).count() == 50

    rows = ohlc_history(store.read_tier, "BTCUSDT", utc(2024, 1, 10), utc(2024, 1, 27)).collect()
    assert len(rows) == 327 and [r.bucket for r in rows] == sorted(r.bucket for r in rows)
    assert sum(r.open for r in rows) == Decimal("16039.05000327") and sum(r.close for r in rows) == Decimal("16068.89000327")
    assert ohlc_history(store.read_tier, "BTCUSDT", utc(2024, 1, 10), utc(2024, 1, 27), "coinbase").count() == 0
    compared = compare_exchanges(store.read_tier(TIERS["hourly"]))
    assert compared.count() == 1724 and compared.agg(F.sum("close_difference")).first()[0] == Decimal("-2420.04998276")


def test_points_whose_ticks_are_gone_go_too(store, ticks):
    day = ticks.filter(F.to_date("time") == date(2024, 1, 15))
    store.append_ticks(day)
    span = utc(2024, 1, 15), utc(2024, 1, 16)
    store.rebuild_tier("hourly", *span)
    store.rebuild_tier("minute", *span)
    assert store.read_tier(TIERS["hourly"]).count() > 0 and store.read_tier(TIERS["minute"]).count() > 0
    store.apply_retention(utc(2024, 4, 1))
    store.rebuild_tier("hourly", *span)
    store.rebuild_tier("minute", *span)
    assert store.read_tier(TIERS["hourly"]).count() == store.read_tier(TIERS["minute"]).count() == 0


def test_rebuild_leaves_unchanged_folders_alone(store, ticks):
    store.append_ticks(ticks.filter(F.col("time") < "2024-01-04"))
    span = utc(2024, 1, 1), utc(2024, 1, 4)
    store.rebuild_tier("hourly", *span)
    files = set(store.read_tier(TIERS["hourly"]).inputFiles())
    more = ticks.filter(F.col("time") < "2024-01-02").limit(1).withColumn("message_id", F.lit("new"))
    store.append_ticks(more)
    store.rebuild_tier("hourly", *span)
    after = set(store.read_tier(TIERS["hourly"]).inputFiles())
    assert {f for f in files if "date=2024-01-01" not in f} == {f for f in after if "date=2024-01-01" not in f}
    assert not {f for f in files & after if "date=2024-01-01" in f}


def test_append_reads_only_the_batch_time_range(store, ticks):
    store.append_ticks(ticks.filter(F.col("time") < "2024-01-03"))
    batch = ticks.filter((F.col("time") >= "2024-01-02 03:00:00") & (F.col("time") < "2024-01-02 04:00:00"))
    plan = store._stored_beside(batch)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time," in plan and ">= 2024-01-02 03:" in plan and "PartitionFilters: [isnotnull(date" in plan


def test_the_largest_price_passes_every_tier(spark, store):
    from tickloom.operators.ticks import to_ticks

    top = 2**63 - 1
    quotes = spark.createDataFrame(
        [("coinbase", "P", top, top, top, 0, f"2024-01-01T00:0{i}:00Z", f"m{i}", i) for i in range(5)],
        "exchange string, crypto_pair string, best_bid bigint, best_ask bigint, price bigint, price_scale int, timestamp string, message_id string, arrival bigint")
    store.append_ticks(to_ticks(quotes, ["arrival"]))
    for name in refresh_order():
        store.rebuild_tier(name, utc(2023, 12, 25), utc(2024, 1, 8))
        points = store.read_tier(TIERS[name]).collect()
        assert sum(p.tick_count for p in points) == 5 and sum(p.price_sum for p in points) == 5 * top
        assert all(p.avg_price == top and p.high == top for p in points)


def test_weighted_mean_is_not_a_mean_of_means(spark):
    points = spark.createDataFrame(
        [(datetime(2024, 1, 1, h), "binance", "P", Decimal(a), Decimal(a), Decimal(a), Decimal(a), Decimal(a), n) for h, a, n in ((0, 1, 1), (1, 4, 2))],
        "bucket timestamp, exchange string, crypto_pair string, open decimal(28,8), high decimal(28,8), low decimal(28,8), close decimal(28,8), avg_price decimal(24,12), tick_count bigint",
    )
    row = ohlc_from_tier(points, DAY).first()
    assert (row.avg_price, row.tick_count, row.open, row.close) == (3, 3, 1, 4)


def test_equal_times_break_ties_the_same_way(spark):
    t = datetime(2024, 1, 1)
    rows = [(t, "binance", "P", Decimal(i), f"m{i}") for i in range(50)]
    schema = "time timestamp, exchange string, crypto_pair string, price decimal(28,8), message_id string"
    seen = {tuple(ohlc_from_ticks(spark.createDataFrame(rows, schema).repartition(n), HOUR).select("open", "close").first()) for n in (1, 2, 7)}
    assert len(seen) == 1


def test_retention_drops_whole_days_only(store, ticks):
    store.append_ticks(ticks)
    store.rebuild_tier("hourly", utc(2024, 1, 1), utc(2024, 2, 1))
    dropped = store.apply_retention(utc(2024, 2, 15, 6))
    assert dropped[0] == "date=2024-01-01" and dropped[-1] == "date=2024-01-14" and len(dropped) == 14
    assert store.read_ticks().count() == 5332
    assert store.read_tier(TIERS["hourly"]).count() == 5525
    assert retention_cutoff(datetime(2024, 3, 31)) == date(2024, 2, 29)


def test_tier_choice_at_its_limits():
    t = utc(2024, 1, 1)
    limits = {"minute": timedelta(minutes=751), "30min": timedelta(minutes=22530), "hourly": timedelta(hours=751)}
    for name, limit in limits.items():
        assert select_tier(t, t + limit - timedelta(seconds=1)).name == name
        assert select_tier(t, t + limit).name == CHART_TIERS[CHART_TIERS.index(name) + 1]


def test_policy_and_requests():
    check_policy()
    order = refresh_order()
    assert order.index("minute") < order.index("30min") and order.index("hourly") < order.index("daily") < order.index("weekly")
    assert TIERS["minute"].refresh_range(utc(2024, 1, 15, 12, 34)) == (utc(2024, 1, 15, 12, 4), utc(2024, 1, 15, 12, 33))
    assert TIERS["daily"].refresh_range(utc(2024, 1, 15, 12, 34)) == (utc(2024, 1, 13), utc(2024, 1, 15))
    assert TIERS["weekly"].refresh_range(utc(2024, 1, 16))[1].weekday() == 0
    assert normalize_exchange("CoinBase") == "coinbase" and normalize_exchange(None) is None
    with pytest.raises(ValueError):
        normalize_exchange("kraken")
    for end in (utc(2024, 1, 1), utc(2023, 12, 31)):
        with pytest.raises(ValueError):
            ohlc_history(lambda *a: None, "BTCUSDT", utc(2024, 1, 1), end)


# -- change log, mergeable points, slices ------------------------------------------------------


def _text(rows):
    return sorted(map(str, rows.collect()))


def test_states_of_any_split_merge_to_the_whole(spark, ticks):
    from tickloom.operators.ohlc import OHLC_COLUMNS, merge_states, states_from_ticks

    moment = datetime(2024, 1, 8, 3, 4, 5)
    tied = spark.createDataFrame(
        [(moment, "binance", "BTCUSDT", Decimal(i), f"tie{i}") for i in range(40)],
        "time timestamp, exchange string, crypto_pair string, price decimal(28,8), message_id string")
    rows = ticks.select(*tied.columns).unionByName(tied)
    part = F.pmod(F.xxhash64("message_id"), F.lit(3))
    states = [states_from_ticks(rows.filter(part == k), timedelta(minutes=1)) for k in (2, 0, 1)]
    split = merge_states(states[0].unionByName(states[1])).unionByName(states[2])
    for name in ("30min", "hourly", "daily", "weekly"):
        tier = TIERS[name]
        want = ohlc_from_ticks(rows, tier.bucket) if name != "weekly" else ohlc_from_tier(
            ohlc_from_ticks(rows, DAY), tier.bucket, tier.bucket_offset)
        got = merge_states(split, tier.bucket, tier.bucket_offset)  # in one pass from minutes
        assert _text(got.select(*OHLC_COLUMNS)) == _text(want.select(*OHLC_COLUMNS))


def test_refresh_after_one_late_tick_touches_only_its_folder(store, ticks):
    day = ticks.filter(F.to_date("time") == date(2024, 1, 15))
    store.append_ticks(day.filter(F.col("time") < "2024-01-15 12:00:00"))
    now = utc(2024, 1, 15, 12, 34)
    store.refresh_rollup("daily", now)
    store.refresh_all(now)
    before = {t: set(store.read_tier(TIERS[t]).inputFiles()) for t in TIERS}
    late = day.filter(F.col("time") >= "2024-01-15 11:00:00").limit(1).withColumns({
        "message_id": F.lit("late"), "time": F.lit("2024-01-15 11:20:00").cast("timestamp"), "price": F.lit(10**9).cast("decimal(28,8)")})
    store.append_ticks(late)
    log = store.log.read("hourly", STATE)
    assert log.filter("seq = 2").count() == 1
    reads = []
    real = TickStore._read
    try:
        TickStore._read = lambda self, path, schema: (reads.append(path), real(self, path, schema))[1]
        store.refresh_rollup("hourly", now)
    finally:
        TickStore._read = real
    assert reads == [store.tier_path(TIERS["hourly"])]  # no ticks
    top = store.read_tier(TIERS["hourly"]).orderBy(F.desc("high")).first()
    assert top.bucket == datetime(2024, 1, 15, 11) and top.high == 10**9
    store.refresh_rollup("hourly", now)  # nothing left to do
    assert store.read_tier(TIERS["hourly"]).orderBy(F.desc("high")).first() == top
    after = set(store.read_tier(TIERS["minute"]).inputFiles())
    assert after == before["minute"]


def test_folding_equals_a_full_build_whatever_the_split(spark, tmp_path, ticks):
    part = ticks.filter((F.col("time") >= "2024-01-08") & (F.col("time") < "2024-01-11"))
    stores = [TickStore(spark, str(tmp_path / x)) for x in "ab"]
    now = utc(2024, 1, 11, 2)
    for k in (1, 0, 2):
        stores[0].append_ticks(part.filter(F.pmod(F.xxhash64("message_id"), F.lit(3)) == k))
        stores[0].refresh_rollup("hourly", now)
    stores[1].append_ticks(part)
    stores[1].rebuild_tier("hourly", utc(2024, 1, 10, 23), utc(2024, 1, 11, 1))
    stores[1].rebuild_tier("daily", utc(2024, 1, 8), utc(2024, 1, 11))
    stores[0].refresh_rollup("daily", now)
    for name in ("hourly", "daily"):
        got, want = (s.read_tier(TIERS[name]) for s in stores)
        assert _text(got) == _text(want) and got.count() > 0
    # a fold that is repeated after its states were not trimmed adds nothing twice
    again = part.limit(1).withColumns({"message_id": F.lit("x"), "time": F.lit("2024-01-10 23:30:00").cast("timestamp")})
    stores[0].append_ticks(again)
    real = type(stores[0].log).trim
    try:
        type(stores[0].log).trim = lambda *a: None
        stores[0].refresh_rollup("hourly", now)
    finally:
        type(stores[0].log).trim = real
    once = _text(stores[0].read_tier(TIERS["hourly"]))
    stores[0].refresh_rollup("hourly", now)
    assert _text(stores[0].read_tier(TIERS["hourly"])) == once


def test_an_append_that_died_is_logged_by_the_next(store, ticks):
    part = ticks.filter((F.col("time") >= "2024-01-15 10:00:00") & (F.col("time") < "2024-01-15 12:00:00"))
    real = TickStore._log_append
    try:
        def dies(self, number, batch=None):
            raise OSError("lost")
        TickStore._log_append = dies
        with pytest.raises(OSError):
            store.append_ticks(part)
    finally:
        TickStore._log_append = real
    assert store.log.unfinished() == [1] and store.log.sealed() == 0
    store.refresh_rollup("hourly", utc(2024, 1, 15, 12, 34))
    assert store.read_tier(TIERS["hourly"]).count() == 0
    store.append_ticks(part)
    assert store.log.unfinished() == [] and store.log.sealed() == 2 and store.read_ticks().count() == part.count()
    store.refresh_rollup("hourly", utc(2024, 1, 15, 12, 34))
    points = store.read_tier(TIERS["hourly"])
    assert points.count() == 14 and points.agg(F.sum("tick_count")).first()[0] == 28


def test_one_old_tick_reads_two_slices(store, ticks):
    few = ticks.filter("time < '2024-01-03' or time >= '2024-01-29'")
    store = TickStore(store.spark, store.root, slice_hours=1)
    store.append_ticks(few)
    old = ticks.filter("time < '2024-01-03'").limit(1)
    recent = ticks.filter("time >= '2024-01-29'").limit(1)
    beside = store._stored_beside(old.unionByName(recent))
    assert beside.select("date", "pair_bucket").distinct().count() == 2
    store.spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    try:
        plan = store._stored_beside(old.unionByName(recent))._jdf.queryExecution().executedPlan().toString()
    finally:
        store.spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "dynamicpruningexpression(date" in plan and "dynamicpruningexpression(pair_bucket" in plan


def test_ticks_written_without_hours_are_still_found(spark, store, ticks):
    from tickloom.plans.store import pair_bucket
    day = ticks.filter(F.to_date("time") == date(2024, 1, 5)).drop("arrival")
    day.withColumns({"date": F.date_format("time", "yyyy-MM-dd"), "pair_bucket": pair_bucket(F.col("crypto_pair"))}) \
        .write.partitionBy("date", "pair_bucket").parquet(store.ticks_path)
    store.append_ticks(ticks.filter(F.to_date("time") == date(2024, 1, 5)))
    assert store.read_ticks().count() == day.count()
    assert store.read_ticks(pair="BTCUSDT").count() == day.filter("crypto_pair = 'BTCUSDT'").count()
