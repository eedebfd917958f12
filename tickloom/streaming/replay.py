"""Replay of stored dead letters, each one once.

The ledger says which letters were tried, in which attempt, and how it ended. An attempt takes the letters that no former
one settled, parses them again, writes what became of them to the folders the ingest stream fills, as batch ``attempt``
of the run ``replay``, and then its own ledger entry. An attempt that dies before that is done again under the same
number and replaces what it wrote, so a letter is published once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from ..operators.monitor import monitor_event
from ..operators.parse import OK, TICKER_COLUMNS, as_quotes, replay_dead_letters
from ..operators.relay import to_relay_json
from ..schemas import LONG, RAW_PAYLOAD, STRING
from ..sinks import keyed_records, read_batches, write_micro_batch
from .jobs import TICKER_SCHEMAS

RUN = "replay"
LETTER = T.StructType([*RAW_PAYLOAD.fields, T.StructField("reason", STRING)])
_KEY = ["lane", "arrival", "digest"]
LEDGER = T.StructType([T.StructField("lane", STRING), T.StructField("arrival", LONG), T.StructField("digest", STRING),
                       T.StructField("status", STRING), T.StructField("attempt", LONG)])


@dataclass(frozen=True)
class DeadLetterReplay:
    """The letters that ``jobs.ingest_batch`` stored for one exchange below ``root``."""

    spark: SparkSession
    root: str
    exchange: str

    @property
    def _ledger_path(self) -> str:
        return f"{self.root}/replays_{self.exchange}"

    def ledger(self) -> DataFrame:
        """lane, arrival and digest of each letter tried, with its status and attempt."""
        if not files.exists(self.spark, self._ledger_path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self._ledger_path)

    def letters(self) -> DataFrame:
        """All stored letters, one row each however many runs stored it. Its place and its text make a letter."""
        rows = read_batches(self.spark, f"{self.root}/dead_letters_{self.exchange}", LETTER, ["lane", "arrival", "raw"])
        return rows.withColumn("digest", F.sha2("raw", 256))

    def pending(self) -> DataFrame:
        """The letters that are neither republished nor found to be no ticker."""
        done = self.ledger().filter(F.col("status").isin("republished", "invalid")).select(*(F.col(k).alias(f"_{k}") for k in _KEY))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in _KEY]
        return self.letters().join(done, same, "left_anti")

    def run(self, fix: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """One attempt over all pending letters; its number, or 0 if none was pending. ``fix`` may put the text in ``raw``
        right and must keep the other columns."""
        if self.pending().isEmpty():
            return 0
        tried = [int(n.removeprefix("attempt=")) for n in files.names(self.spark, self._ledger_path) if n.startswith("attempt=")]
        attempt = 1 + max(tried, default=0)
        letters = self.pending().drop("reason")
        replayed = replay_dead_letters(fix(letters) if fix else letters, self.exchange)
        with files.staged(replayed) as done:
            ok = done.filter(F.col("outcome") == OK)
            tickers = ok.select("exchange", "lane", "arrival", *TICKER_COLUMNS[self.exchange])
            self._write(tickers, "tickers", attempt)
            sent = to_relay_json(tickers, TICKER_SCHEMAS[self.exchange], ["crypto_pair"])
            self._write(keyed_records(sent, "crypto_pair"), "keyed", attempt)
            self._write(as_quotes(done, self.exchange), "quotes", attempt)
            audit = monitor_event(
                done, F.col("message"), F.col("level"), origin="ingestor", at=F.col("timestamp"),
                name=F.concat_ws("|", F.lit(RUN), "exchange", "lane", F.col("arrival").cast("string"), F.lit(str(attempt))))
            self._write(audit, "audit", attempt)
            entry = done.select(*_KEY, "status", F.lit(attempt).cast("bigint").alias("attempt"))
            entry.write.mode("overwrite").parquet(f"{self._ledger_path}/attempt={attempt}")
        return attempt

    def _write(self, rows: DataFrame, name: str, attempt: int) -> None:
        write_micro_batch(rows, f"{self.root}/{name}_{self.exchange}", attempt, RUN)
