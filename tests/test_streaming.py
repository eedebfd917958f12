"""Streams against the batch operators on the same rows."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators.monitor import read_monitor_json, reshape_monitor, valid_monitor
from tickloom.operators.pairs import to_canonical
from tickloom.operators.parse import parse_raw
from tickloom.operators.relay import to_relay_json
from tickloom.operators.spread import spread_changelog_by_time
from tickloom.operators.throttle import latest_per_key, throttle_closed
from tickloom.operators.ticks import to_ticks
from tickloom.plans.store import TickStore
from tickloom.sinks import keyed_records, read_batches, write_labelled_logs, write_micro_batch
from tickloom.sources import event_views as views
from tickloom.sources.feeds import (
    kafka_options, read_raw_text, read_table, stream_raw_text, stream_table, stream_text_blocks,
)
from tickloom.streaming.jobs import (
    LandedLines, OrderedSpreadStream, SpreadStream, ThrottleStream, ingest_batch, monitor_batch, relay_batch, start, tick_batch,
)
from tickloom.streaming import replay as module
from tickloom.streaming.replay import DeadLetterReplay
from tickloom.streaming.windows import dedupe_stream, throttle_stream

T0 = datetime(2024, 1, 1)


@pytest.fixture
def quote_files(spark, tmp_path):
    """Quotes of the smallest data set as six files, delivered in order."""
    rows = views.laned_quotes(spark, "/root/testdata/sf0.001").select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.QUOTE.fields)
    ).persist()
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    step = (last - first) // 6 + 1
    for i in range(6):
        part = rows.filter(F.floor((F.unix_micros("ts") - first) / step) == i)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "quotes"))
    return str(tmp_path / "quotes"), rows


def drain(stream, path, checkpoint):
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None


def test_spread_stream_equals_changelog_and_survives_reruns(spark, quote_files, tmp_path):
    path, rows = quote_files
    job = SpreadStream(str(tmp_path / "out"))
    calls = []

    def twice(batch, batch_id):
        job(batch, batch_id)
        job(batch, batch_id)
        calls.append(batch_id)

    start(stream_table(spark, path, schemas.QUOTE, 1), twice, str(tmp_path / "cp")).awaitTermination(240)
    assert len(calls) == 6
    assert len(list((tmp_path / "out" / "spread_state").glob("batch_id=*"))) <= 3
    got = spark.read.parquet(str(tmp_path / "out" / "spread")).drop("batch_id")
    want = spread_changelog_by_time(to_canonical(rows), keep=["exchange", "lane", "arrival"])
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_tick_stream_adds_each_key_once_and_reports_bad_quotes(spark, quote_files, tmp_path):
    path, rows = quote_files
    rows.limit(3).withColumn("timestamp", F.lit("never")).withColumn("message_id", F.lit("bad")).coalesce(1).write.mode("append").parquet(path)
    store = TickStore(spark, str(tmp_path / "db"))
    for attempt in ("a", "b"):
        start(
            stream_table(spark, path, schemas.QUOTE, 4), tick_batch(store, str(tmp_path / "audit")), str(tmp_path / attempt)
        ).awaitTermination(240)
        assert store.read_ticks().count() == rows.count()
    audit = spark.read.parquet(str(tmp_path / "audit" / "audit_ticks"))
    assert audit.count() == 3 and audit.filter(F.col("message").startswith("Failed to map ")).count() == 3
    want = to_ticks(rows)
    assert sorted(map(str, store.read_ticks().collect())) == sorted(map(str, want.select(store.read_ticks().columns).collect()))


def test_ingest_stream_writes_every_output(spark, tmp_path):
    raw = views.coinbase_raw(spark, "/root/testdata/sf0.001").select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.RAW_PAYLOAD.fields)
    )
    raw.repartition(3).write.parquet(str(tmp_path / "raw"))
    stream = stream_table(spark, str(tmp_path / "raw"), schemas.RAW_PAYLOAD, 1)
    start(stream, ingest_batch("coinbase", str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination(240)
    want = parse_raw(raw, "coinbase")
    for name, df in (("tickers", want.ok), ("quotes", want.ok), ("keyed", want.ok), ("dead_letters", want.dead_letters), ("audit", want.audit)):
        assert spark.read.parquet(str(tmp_path / "out" / f"{name}_coinbase")).count() == df.count() > 0


def test_throttle_stream_emits_closed_windows_once(spark, tmp_path):
    def row(pair, ms, n):
        return ("binance", pair, 1, 2, None, 8, "t", f"m{n}", "0", n, T0 + timedelta(milliseconds=ms))

    batches = [
        [row("A", 10, 0), row("A", 400, 1), row("A", 300, 2), row("B", 450, 3)],
        [row("A", 700, 4)], [row("B", 2600, 5)], [row("A", 9000, 6)], [row("A", 100, 7)], [row("B", 9100, 8)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schemas.QUOTE).coalesce(1).write.mode("append").parquet(str(tmp_path / "q"))
    out = str(tmp_path / "out")
    drain(throttle_stream(stream_table(spark, str(tmp_path / "q"), schemas.QUOTE, 1)), out, str(tmp_path / "cp"))
    got = sorted((r.crypto_pair, (r.window_start - T0) // timedelta(milliseconds=1), r.message_id) for r in spark.read.parquet(out).collect())
    # The last row by arrival wins, not the latest by time; the window at 9000 stays open.
    assert got == [("A", 0, "m2"), ("A", 500, "m4"), ("B", 0, "m3"), ("B", 2500, "m5")]


def test_spread_pairs_by_record_time_across_topics(spark, tmp_path):
    """Topics with positions of their own: b1 c1 b2 c2 gives three events, none with a price from the future."""
    def quote(exchange, pair, n, second):
        return (exchange, pair, 1, 2, 1, 2, f"t{second}", f"{exchange[0]}{n}", "0", n, T0 + timedelta(seconds=second))

    rows = [quote("binance", "BTCUSDT", 1000, 1), quote("coinbase", "BTC-USDT", 1, 2),
            quote("binance", "BTCUSDT", 1001, 3), quote("coinbase", "BTC-USDT", 2, 4)]
    job = SpreadStream(str(tmp_path / "out"))
    job(spark.createDataFrame(rows[:3], schemas.QUOTE), 0)
    job(spark.createDataFrame(rows[3:], schemas.QUOTE), 1)
    events = spark.read.parquet(str(tmp_path / "out" / "spread")).orderBy("timestamp").collect()
    assert [e.timestamp for e in events] == ["t2", "t3", "t4"]


def test_exact_throttle_keeps_a_lagging_lane(spark, tmp_path):
    """One exchange 40 seconds behind the other over many batches: all its windows come out."""
    def quote(exchange, n):
        late = 40_000 if exchange == "coinbase" else 0
        ms = n * 700 - late - (1700 if n % 7 == 3 else 0)
        return (exchange, "AB"[n % 2], 1, 2, 1, 8, "t", f"{exchange}{n}", "0", n, T0 + timedelta(milliseconds=ms))

    rows = [quote(e, n) for n in range(48) for e in ("binance", "coinbase")]
    for i in range(8):
        part = spark.createDataFrame(rows[i * 12:(i + 1) * 12], schemas.QUOTE)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "q"))
    job = ThrottleStream(str(tmp_path / "out"))

    def twice(batch, batch_id):
        job(batch, batch_id)
        job(batch, batch_id)

    start(stream_table(spark, str(tmp_path / "q"), schemas.QUOTE, 1), twice, str(tmp_path / "cp")).awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out" / "latest")).drop("batch_id")
    want = throttle_closed(spark.createDataFrame(rows, schemas.QUOTE))
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.filter("exchange = 'coinbase'").count() > 30


def test_raw_text_stream_has_stable_positions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / f"{name}.txt").write_text("".join(f'{{"n":{i}}}\n' for i in range(5)))
    drain(stream_raw_text(spark, str(tmp_path / "in"), "binance", 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.lane[-5:], r.arrival, r.raw) for r in rows) == [(f"{f}.txt", i, f'{{"n":{i}}}') for f in "ab" for i in range(5)]


def test_dedupe_stream(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=i % 4), "binance", "P", None, f"m{i % 4}") for i in range(12)]
    spark.createDataFrame(rows, "time timestamp, exchange string, crypto_pair string, price decimal(28,8), message_id string").repartition(3).write.parquet(str(tmp_path / "t"))
    out = str(tmp_path / "out")
    drain(dedupe_stream(stream_table(spark, str(tmp_path / "t"), schemas.TICK, 1), timedelta(minutes=1)), out, str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 4


def test_relay_json_and_keys(spark):
    rows = spark.createDataFrame([(None, "BTCUSDT", 1, 2, 3, 4, 2**60, "t", "m", 8)], schemas.BINANCE_TICKER)
    body = json.loads(to_relay_json(rows, schemas.BINANCE_TICKER).first().value)
    assert body["volume"] == str(2**60) and body["price_scale"] == 8 and body["event_time"] == "0"
    assert list(body) == [f.name for f in schemas.BINANCE_TICKER.fields]
    spread = spark.createDataFrame([("P", "m", "t", 1.5, 2.0, 3.0, 4.0, 1e-8, -2.25)], schemas.SPREAD_EVENT)
    body = json.loads(to_relay_json(spread, schemas.SPREAD_EVENT).first().value)
    assert body["spread_buy_binance_sell_coinbase"] == 1e-8 and body["binance_best_ask"] == 2.0
    keyed = keyed_records(to_relay_json(rows, schemas.BINANCE_TICKER, ["crypto_pair"]), "crypto_pair")
    assert keyed.columns == ["key", "value"] and keyed.first().key == "BTCUSDT"


def test_labelled_logs_and_folders(spark, tmp_path):
    lines = reshape_monitor(read_monitor_json(views.monitor_messages(spark, "/root/testdata/sf0.001").drop("event_id"))).filter("level is not null")
    write_labelled_logs(lines, str(tmp_path / "logs"))
    write_labelled_logs(lines, str(tmp_path / "logs"))  # the same batch again
    back = spark.read.json(str(tmp_path / "logs"))
    assert back.count() == lines.count() and {"service_name", "level", "environment"} <= set(back.columns)
    write_micro_batch(lines, str(tmp_path / "m"), 0)
    write_micro_batch(lines, str(tmp_path / "m"), 0)
    assert spark.read.parquet(str(tmp_path / "m")).count() == lines.count()


def test_feeds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"e":"x"}\n\n')
    raw = read_raw_text(spark, str(tmp_path / "in"), "binance")
    assert raw.columns == [f.name for f in schemas.RAW_PAYLOAD.fields] and raw.count() == 2
    options = kafka_options("b:1", "binance-topic", 100)
    assert options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "100"
    raw.write.parquet(str(tmp_path / "p"))
    assert read_table(spark, str(tmp_path / "p"), schemas.RAW_PAYLOAD).count() == 2


# -- runs, divisible text, replay, relay, monitor, order across batches -------------------------


def _stream_raw(spark, tmp_path, exchange, view):
    raw = view(spark, "/root/testdata/sf0.001").select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.RAW_PAYLOAD.fields))
    raw.repartition(2).write.parquet(str(tmp_path / "raw"))
    return raw, stream_table(spark, str(tmp_path / "raw"), schemas.RAW_PAYLOAD, 1)


def test_a_new_checkpoint_keeps_former_letters_and_replay_publishes_each_once(spark, tmp_path):
    raw, stream = _stream_raw(spark, tmp_path, "binance", views.binance_raw)
    out = str(tmp_path / "out")
    start(stream, ingest_batch("binance", out), str(tmp_path / "a")).awaitTermination(240)
    letters = parse_raw(raw, "binance").dead_letters.count()
    assert spark.read.parquet(f"{out}/dead_letters_binance").count() == letters > 0
    (tmp_path / "raw2").mkdir()
    raw.limit(0).write.mode("overwrite").parquet(str(tmp_path / "raw2"))  # the source no longer holds them
    start(stream_table(spark, str(tmp_path / "raw2"), schemas.RAW_PAYLOAD, 1), ingest_batch("binance", out), str(tmp_path / "b")).awaitTermination(240)
    replay = DeadLetterReplay(spark, out, "binance")
    assert replay.letters().count() == letters

    def fix(rows):
        return rows.withColumn("raw", F.replace("raw", F.lit('"x"'), F.lit('"1"')))

    tickers = spark.read.parquet(f"{out}/tickers_binance").count()
    assert replay.run() == 1  # nothing fixed: all stay
    assert replay.pending().count() == letters and spark.read.parquet(f"{out}/tickers_binance").count() == tickers
    real, module.monitor_event = module.monitor_event, None  # dies after the tickers are written
    with pytest.raises(TypeError):
        replay.run(fix)
    module.monitor_event = real
    assert replay.run(fix) == 2
    good = replay.ledger().filter("status = 'republished'").count()
    assert 0 < good < letters and replay.pending().count() == letters - good
    assert spark.read.parquet(f"{out}/tickers_binance").count() == tickers + good
    assert replay.run(fix) == 3 and spark.read.parquet(f"{out}/tickers_binance").count() == tickers + good
    audit = spark.read.parquet(f"{out}/audit_binance").filter("run = 'replay'")
    assert audit.filter("level = 'INFO'").count() == good
    again = read_batches(spark, f"{out}/tickers_binance", schemas.BINANCE_TICKER)
    assert again.count() == tickers + good


def test_outputs_of_all_runs_are_read_and_repeated_rows_once(spark, tmp_path):
    rows = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int")
    path = str(tmp_path / "t")
    assert read_batches(spark, path, rows.schema).count() == 0
    for run in ("one", "two"):
        write_micro_batch(rows, path, 0, run)
        write_micro_batch(rows, path, 0, run)
    write_micro_batch(rows.withColumn("k", F.lit("k3")), path, 7, "one")
    assert read_batches(spark, path, rows.schema).count() == 6
    assert sorted(r.k for r in read_batches(spark, path, rows.schema, ["k", "v"]).collect()) == ["k1", "k2", "k3", "k3"]


@pytest.mark.parametrize("lane", [None, "topic-0"])
def test_positions_do_not_depend_on_how_files_split(spark, tmp_path, lane):
    (tmp_path / "in").mkdir()
    texts = {"b.txt": [f'{{"n":{i},"pad":"{"x" * (i % 90)}"}}' for i in range(700)], "a.txt": ["one", "", "é\tthree"], "c.txt": []}
    for k, name in enumerate(("b.txt", "a.txt", "c.txt")):
        path = tmp_path / "in" / name
        path.write_bytes("\r\n".join(texts[name]).encode() + (b"\n" if name == "b.txt" else b""))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))

    def read():
        rows = read_raw_text(spark, str(tmp_path / "in"), "binance", lane)
        return sorted((r.lane.split("/")[-1], r.arrival, r.raw) for r in rows.collect()), rows.rdd.getNumPartitions()

    whole, _ = read()
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1500)
    try:
        parts, _ = read()
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts == whole
    if lane is None:
        assert whole == sorted((n, i, t) for n, lines in texts.items() for i, t in enumerate(lines))
    else:
        assert whole == sorted((lane, i, t) for i, t in enumerate(texts["b.txt"] + texts["a.txt"]))


def test_landed_lines_go_on_from_batch_to_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, name in enumerate("ab"):
        (tmp_path / "in" / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(4)))
        os.utime(tmp_path / "in" / f"{name}.txt", (1_700_000_000 + k, 1_700_000_000 + k))
    job = LandedLines(str(tmp_path / "s"), "binance", "topic-0", lambda raw, n: write_micro_batch(raw, str(tmp_path / "o"), n))

    def twice(batch, batch_id):
        job(batch, batch_id)
        job(batch, batch_id)

    start(stream_text_blocks(spark, str(tmp_path / "in"), 1), twice, str(tmp_path / "cp")).awaitTermination(240)
    rows = read_batches(spark, str(tmp_path / "o"), schemas.RAW_PAYLOAD).collect()
    assert sorted((r.lane, r.arrival, r.raw) for r in rows) == [("topic-0", i, f"{'ab'[i // 4]}{i % 4}") for i in range(8)]


def test_topics_in_any_mixture_of_batches_give_the_changelog(spark, tmp_path):
    rows = views.laned_quotes(spark, "/root/testdata/sf0.001").select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.QUOTE.fields)).limit(400).persist()
    lanes = sorted({(r.exchange, r.lane) for r in rows.select("exchange", "lane").collect()})
    rng, queue = random.Random(4), []
    data = sorted(rows.collect(), key=lambda r: (r.ts, r.exchange, r.lane, r.arrival))
    pending = {lane: [r for r in data if (r.exchange, r.lane) == lane] for lane in lanes}
    while any(pending.values()):  # each lane in order, the lanes in any mixture
        batch = []
        for lane in rng.sample(lanes, 2):
            n = rng.randint(0, 60)
            batch, pending[lane] = batch + pending[lane][:n], pending[lane][n:]
        queue.append(batch)
    job = OrderedSpreadStream(str(tmp_path / "out"), idle=timedelta(days=400), lanes=tuple("/".join(x) for x in lanes))
    for n, batch in enumerate([*queue, []]):
        frame = spark.createDataFrame(batch, schemas.QUOTE)
        (job if n < len(queue) else job.flush)(frame, n)
        if n == 1:
            job(frame, n)
    got = spark.read.parquet(str(tmp_path / "out" / "spread"))
    want = spread_changelog_by_time(to_canonical(rows), keep=["exchange", "lane", "arrival"])
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.count() > 50


def test_a_silent_topic_holds_others_back_for_the_idle_time_only(spark, tmp_path):
    def quote(exchange, n, second):
        pair = "BTCUSDT" if exchange == "binance" else "BTC-USDT"
        return (exchange, pair, 1, 2, 1, 2, f"t{second}", f"{exchange[0]}{n}", "0", n, T0 + timedelta(seconds=second))

    job = OrderedSpreadStream(str(tmp_path / "out"), idle=timedelta(seconds=30), lanes=("coinbase/0",))

    def sent(batch, n):
        job(spark.createDataFrame(batch, schemas.QUOTE), n)
        return spark.read.parquet(str(tmp_path / "out" / "spread")).count()

    assert sent([quote("binance", 1, 0), quote("binance", 2, 10)], 0) == 0
    waiting = spark.read.parquet(str(tmp_path / "out" / "order_waiting"))
    assert waiting.filter("batch_id = 0").count() == 2  # for the topic that has sent nothing
    assert sent([quote("coinbase", 1, 5)], 1) == 0       # b1 may go, c1 waits for its own clock to pass
    assert sent([quote("binance", 3, 50)], 2) == 2       # coinbase is silent now: c1 with b1, b2 with c1


def test_relay_and_monitor_streams(spark, quote_files, tmp_path):
    path, rows = quote_files
    root = str(tmp_path / "out")
    spreads = SpreadStream(root)
    start(stream_table(spark, path, schemas.QUOTE, 3), spreads, str(tmp_path / "a")).awaitTermination(240)
    events = spark.read.parquet(f"{root}/spread")
    for attempt in range(2):
        start(stream_table(spark, f"{root}/spread/run=*/batch_id=*", schemas.SPREAD_EVENT, 1),
              relay_batch(schemas.SPREAD_EVENT, "crypto_pair", f"{root}/clients"), str(tmp_path / "b")).awaitTermination(240)
    sent = spark.read.parquet(f"{root}/clients")
    assert sent.count() == events.count() > 0
    assert {json.loads(r.value)["message_id"] for r in sent.collect()} == {r.message_id for r in events.collect()}

    messages = views.monitor_messages(spark, "/root/testdata/sf0.001").select("value")
    messages = messages.unionByName(spark.createDataFrame([("{bad",), (None,)], "value string"))
    messages.repartition(2).write.parquet(str(tmp_path / "m"))
    start(stream_table(spark, str(tmp_path / "m"), messages.schema, 1), monitor_batch(f"{root}/mon"), str(tmp_path / "c")).awaitTermination(240)
    valid = valid_monitor(read_monitor_json(messages)).count()
    assert spark.read.json(f"{root}/mon/logs").count() == valid > 0
    assert spark.read.parquet(f"{root}/mon/invalid").count() == messages.count() - valid


def test_lanes_that_ended_give_their_last_windows_and_are_forgotten(spark, tmp_path):
    def quote(lane, n, ms):
        return ("binance", "A", 1, 2, None, 8, "t", f"{lane}{n}", lane, n, T0 + timedelta(milliseconds=ms))

    job = ThrottleStream(str(tmp_path / "out"), retire=timedelta(seconds=20))
    batches = [[quote("f1", 0, 100), quote("f1", 1, 200)], [quote("f2", 0, 10_000)], [quote("f3", 0, 40_000)], [quote("f3", 1, 45_000)]]
    for n, batch in enumerate(batches):
        for _ in range(2):
            job(spark.createDataFrame(batch, schemas.QUOTE), n)
    got = spark.read.parquet(str(tmp_path / "out" / "latest"))
    assert sorted(r.message_id for r in got.collect()) == ["f11", "f20", "f30"]
    clocks = spark.read.parquet(str(tmp_path / "out" / "throttle_clock")).filter("batch_id = 3")
    assert [r.feed for r in clocks.collect()] == ["binance/f3"]


def test_rows_without_a_key_are_no_latest_rows(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), (None, 3, 7)], "k string, arrival long, v long")
    assert [tuple(r) for r in latest_per_key(rows, ["k"]).collect()] == [("a", 2, 6)]
