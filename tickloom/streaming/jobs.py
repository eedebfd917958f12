"""Streams that write several outputs or keep a table: one function per micro-batch.

Every function may run twice for one batch id, after a lost executor or a restart, and leaves the same
result as running once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.clock import micros
from ..operators.monitor import read_monitor_json, reshape_monitor, valid_monitor
from ..operators.pairs import to_canonical
from ..operators.parse import TICKER_COLUMNS, as_quotes, dead_letters, ingest_audit, parser_of
from ..operators.relay import to_relay_json
from ..operators.sizing import broadcast_if_small
from ..operators.spread import TIME_ORDER, scale_errors, spread_changelog, usable_scale, with_time_chunks
from ..operators.throttle import GRACE, WINDOW, drop_late, is_closed, latest_per_key
from ..operators.ticks import mapping_audit, mapping_errors, to_ticks
from ..plans.store import TickStore
from ..schemas import BINANCE_TICKER, COINBASE_TICKER
from ..sinks import drop_batches, keyed_records, run_path, write_labelled_logs, write_micro_batch
from ..sources.feeds import numbered_lines

Batch = Callable[[DataFrame, int], None]
TICKER_SCHEMAS = {"binance": BINANCE_TICKER, "coinbase": COINBASE_TICKER}


def start(stream: DataFrame, batch: Batch, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``batch`` over the stream: until what is there is done, or without end."""
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_batch(exchange: str, root: str) -> Batch:
    """Raw messages to quotes, tickers, records keyed by pair, dead letters and audit events. The parse runs once for all."""

    def run(raw: DataFrame, batch_id: int) -> None:
        parsed = parser_of(exchange)(raw).persist()
        try:
            ok = parsed.filter(F.col("outcome") == "ok").select("exchange", "lane", "arrival", *TICKER_COLUMNS[exchange])
            write_micro_batch(ok, f"{root}/tickers_{exchange}", batch_id)
            keyed = keyed_records(to_relay_json(ok, TICKER_SCHEMAS[exchange], ["crypto_pair"]), "crypto_pair")
            write_micro_batch(keyed, f"{root}/keyed_{exchange}", batch_id)
            write_micro_batch(as_quotes(parsed, exchange), f"{root}/quotes_{exchange}", batch_id)
            letters = dead_letters(parsed).select(*raw.columns, "reason")
            write_micro_batch(letters, f"{root}/dead_letters_{exchange}", batch_id, once_by=["lane", "arrival", "raw"])
            write_micro_batch(ingest_audit(parsed), f"{root}/audit_{exchange}", batch_id, once_by=["messageId"])
        finally:
            parsed.unpersist()

    return run


def tick_batch(store: TickStore, audit_root: str) -> Batch:
    """Quotes to the tick table, each key once; quotes that do not map become audit events."""

    def run(quotes: DataFrame, batch_id: int) -> None:
        kept = quotes.persist()
        try:
            store.append_ticks(to_ticks(kept, keep=["arrival"]))
            write_micro_batch(mapping_audit(mapping_errors(kept)), f"{audit_root}/audit_ticks", batch_id, once_by=["messageId"])
        finally:
            kept.unpersist()

    return run


_QUOTE = ["exchange", "canonical_pair", "best_bid", "best_ask", "price_scale", "message_id", "timestamp", "ts", "lane", "arrival"]


def _former(rows: DataFrame, path: str, batch_id: int) -> DataFrame | None:
    """State as the batch before left it in this run. One batch further back may go: a batch that runs again needs only this."""
    if batch_id == 0:
        return None
    here = run_path(rows, path)
    drop_batches(rows.sparkSession, here, lambda n: n < batch_id - 1)
    return rows.sparkSession.read.parquet(f"{here}/batch_id={batch_id - 1}")


@dataclass(frozen=True)
class LandedLines:
    """A stream of ``feeds.stream_text_blocks`` as raw payload rows of one lane, given to another batch function.

    Positions go on from batch to batch, files within a batch in the order in which they landed. State is one number.
    """

    root: str
    exchange: str
    lane: str
    then: Batch

    def __call__(self, blocks: DataFrame, batch_id: int) -> None:
        path = f"{self.root}/landed_{self.exchange}"
        before = _former(blocks, path, batch_id)
        start = before.first()["lines"] if before is not None else 0
        here = blocks.persist()
        try:
            self.then(numbered_lines(here, self.exchange, self.lane, start), batch_id)
            write_micro_batch(here.agg((F.count(F.lit(1)) + start).alias("lines")), path, batch_id)
        finally:
            here.unpersist()


def relay_batch(message: T.StructType, key: str, path: str, keep: list[str] | None = None) -> Batch:
    """Latest quotes, tickers or spread events to clients: one JSON text per event, equal keys in one file and in order."""

    def run(events: DataFrame, batch_id: int) -> None:
        sent = to_relay_json(events, message, list(dict.fromkeys([key, *(keep or [])])))
        write_micro_batch(keyed_records(sent, key), path, batch_id)

    return run


def monitor_batch(root: str, value: str = "value") -> Batch:
    """Monitoring events as JSON texts to log lines by label; texts that are no event, or one without message or level,
    are kept aside as they came."""

    def run(messages: DataFrame, batch_id: int) -> None:
        kept = messages.withColumn("_text", F.col(value)).persist()
        try:
            events = read_monitor_json(kept, value)
            write_labelled_logs(reshape_monitor(valid_monitor(events)), f"{root}/logs", batch_id)
            valid = (F.length("message") > 0) & (F.length("level") > 0)
            rest = events.filter(~F.coalesce(valid, F.lit(False))).select(F.col("_text").alias(value))
            write_micro_batch(rest, f"{root}/invalid", batch_id)
        finally:
            kept.unpersist()

    return run


@dataclass(frozen=True)
class SpreadStream:
    """Spread events of a quote stream, by record time, then exchange, lane and position.

    State is the latest quote per exchange and canonical pair, one small folder per batch. Each batch is the
    batch operator over state and new quotes, so a busy pair is spread over tasks like any other rows
    instead of passing through one keyed state handler. State counts as before every new quote, whatever its time.
    Quotes whose scale cannot be used go to ``spread_errors``.
    """

    root: str

    def __call__(self, quotes: DataFrame, batch_id: int) -> None:
        canonical = to_canonical(quotes).select(*_QUOTE)
        fresh = canonical.withColumn("_new", F.lit(1))
        state = _former(quotes, f"{self.root}/spread_state", batch_id)
        rows = fresh
        if state is not None:
            rows = state.select(*_QUOTE).withColumn("_new", F.lit(0)).unionByName(fresh)
        rows = rows.persist()
        try:
            order = ["_new", *TIME_ORDER]
            chunk = F.when(F.col("_new") == 0, F.lit(-(1 << 62))).otherwise(F.col("_time_chunk"))
            events = spread_changelog(with_time_chunks(rows, ["canonical_pair"]), order, chunk, keep=["_new", "exchange", "lane", "arrival"])
            write_micro_batch(events.filter(F.col("_new") == 1).drop("_new"), f"{self.root}/spread", batch_id)
            write_micro_batch(scale_errors(rows.filter("_new = 1")).drop("_new"), f"{self.root}/spread_errors", batch_id)
            others = [c for c in _QUOTE if c not in ("exchange", "canonical_pair")]
            latest = rows.filter(usable_scale()).groupBy("exchange", "canonical_pair").agg(
                F.max_by(F.struct(*others), F.struct("_new", "ts", "lane", "arrival")).alias("_last")
            ).select("exchange", "canonical_pair", "_last.*")
            write_micro_batch(latest, f"{self.root}/spread_state", batch_id)
        finally:
            rows.unpersist()


@dataclass(frozen=True)
class OrderedSpreadStream:
    """``SpreadStream`` over topics whose records reach the stream in any mixture of micro-batches.

    A quote waits until the clock of every active lane (exchange and lane) has passed its time; then all that may go are handed
    on in time order. A lane's clock is its latest record time. ``lanes`` names lanes ("exchange/lane") that hold others back
    before their first record. A lane more than ``idle`` behind the leading one is silent and holds nothing back, so one
    dead topic delays events by ``idle`` and no more; a record of it that comes later still counts when it comes. The same
    holds for records that go back in time within their lane by more than ``slack``.

    State per batch: each lane's clock, and the quotes that wait. ``flush`` lets those out at the end of a feed.
    """

    root: str
    idle: timedelta = timedelta(minutes=1)
    slack: timedelta = timedelta(0)
    lanes: tuple[str, ...] = ()

    def __call__(self, quotes: DataFrame, batch_id: int) -> None:
        self._run(quotes, batch_id, False)

    def flush(self, quotes: DataFrame, batch_id: int) -> None:
        """A last batch after which nothing waits."""
        self._run(quotes, batch_id, True)

    def _run(self, quotes: DataFrame, batch_id: int, last: bool) -> None:
        spark, clock_path = quotes.sparkSession, f"{self.root}/order_clock"
        before = _former(quotes, clock_path, batch_id)
        waiting = _former(quotes, f"{self.root}/order_waiting", batch_id)
        rows = (quotes if waiting is None else quotes.unionByName(waiting)).persist()
        try:
            at = F.unix_micros(F.col("ts").cast("timestamp"))
            seen = rows.select(F.concat_ws("/", "exchange", "lane").alias("feed"), at.alias("clock"), at.alias("since"))
            if before is not None:
                seen = seen.unionByName(before)
            elif self.lanes:
                none = F.lit(None).cast("bigint")
                named = spark.createDataFrame([(x,) for x in self.lanes], "feed string")
                seen = seen.unionByName(named.select("feed", none.alias("clock"), none.alias("since")))
            clock = seen.groupBy("feed").agg(F.max("clock").alias("clock"), F.min("since").alias("since"))
            write_micro_batch(clock, clock_path, batch_id)
            clock = spark.read.schema(clock.schema).parquet(f"{run_path(quotes, clock_path)}/batch_id={batch_id}")
            free = F.lit(True) if last else self._free(clock, at)
            write_micro_batch(rows.filter(~free), f"{self.root}/order_waiting", batch_id)
            SpreadStream(self.root)(rows.filter(free), batch_id)
        finally:
            rows.unpersist()

    def _free(self, clock: DataFrame, at: Column) -> Column:
        """Whether a quote may go. A lane without a record counts as standing where the feeds began."""
        lead, since = clock.agg(F.max("clock"), F.min("since")).first()
        if lead is None:
            return F.lit(True)
        where = F.coalesce("clock", F.lit(since))
        border = clock.filter(where >= lead - micros(self.idle)).agg(F.min(where)).first()[0]
        return at < border - micros(self.slack)


@dataclass(frozen=True)
class ThrottleStream:
    """The last quote by position per lane, pair and window, written once its window is closed: the exact late rule of
    ``throttle_closed``, lane by lane, so a lane that lags behind the others loses nothing.

    State per batch: each lane's clock, and the latest quotes of windows still open. The lane's clock enters the next
    batch's rule as a row before all others.

    With ``retire`` a lane whose clock is that far behind the leading one has ended: its open windows are written and its clock
    is forgotten. Needed where lanes end, as landed files do; a record of such a lane that still comes begins a new lane.
    """

    root: str
    size: timedelta = WINDOW
    grace: timedelta = GRACE
    retire: timedelta | None = None

    def __call__(self, quotes: DataFrame, batch_id: int) -> None:
        fresh = quotes.withColumn("feed", F.concat_ws("/", "exchange", "lane")).persist()
        clocks = _former(quotes, f"{self.root}/throttle_clock", batch_id)
        open_rows = _former(quotes, f"{self.root}/throttle_open", batch_id)
        try:
            rows = fresh.withColumn("_clock_row", F.lit(False))
            times = fresh.select("feed", "ts")
            if clocks is not None:
                before = clocks.select("feed", F.col("clock").alias("ts"), F.lit(-(1 << 62)).alias("arrival"))
                rows = rows.unionByName(before.withColumn("_clock_row", F.lit(True)), allowMissingColumns=True)
                times = times.unionByName(before.select("feed", "ts"))
            clock = times.groupBy("feed").agg(F.max("ts").alias("clock")).persist()
            on_time = drop_late(rows, self.size, self.grace, lane="feed").filter("not _clock_row").drop("_clock_row")
            if open_rows is not None:
                on_time = on_time.unionByName(open_rows.select(*on_time.columns))
            latest = latest_per_key(on_time, ["feed", "crypto_pair", "window_start"]).join(broadcast_if_small(clock), "feed")
            ended = F.lit(False)
            at = F.unix_micros(F.col("clock").cast("timestamp"))
            lead = clock.agg(F.max(at)).first()[0] if self.retire is not None else None
            if lead is not None:
                ended = at < lead - micros(self.retire)
            closed = ended | is_closed(F.col("window_start"), F.col("clock"), self.size, self.grace)
            latest = latest.withColumn("_closed", closed).persist()
            columns = [*quotes.columns, "window_start"]
            write_micro_batch(latest.filter("_closed").select(*columns), f"{self.root}/latest", batch_id)
            write_micro_batch(latest.filter("not _closed").select("feed", *columns), f"{self.root}/throttle_open", batch_id)
            write_micro_batch(clock.filter(~ended), f"{self.root}/throttle_clock", batch_id)
            for kept in (latest, clock):
                kept.unpersist()
        finally:
            fresh.unpersist()
