"""What changed since a tier was last refreshed.

Every append has a number. While it runs a marker says so; when its ticks are written, what they add to the tiers built
from ticks is logged: one mergeable state per touched bucket, exchange and pair, with the append's number. A refresh folds the
states of its range into the stored points and takes them out of the log. A stored point carries the number of
the last append in it, so a state that is folded again after a crash changes nothing. Tiers built from other tiers
have a log of touched buckets only, which they recompute from the few points below.

An append that died leaves its marker; the next one logs what it had written. One job appends at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from ..operators.ohlc import KEYS, ORDER
from ..schemas import OHLC

_BUCKET = [f for f in OHLC.fields if f.name in KEYS]
_ORDER = T.DecimalType(*map(int, ORDER.removeprefix("decimal(").rstrip(")").split(",")))
#: A point as it lies on disk: what merges, and the last append in it.
STATE = T.StructType([*OHLC.fields, T.StructField("open_order", _ORDER), T.StructField("close_order", _ORDER), T.StructField("seq", T.LongType())])
TOUCHED = T.StructType(_BUCKET)


@dataclass(frozen=True)
class ChangeLog:
    """Markers of appends, and one folder of entries per tier, below one folder."""

    spark: SparkSession
    root: str

    # -- appends -------------------------------------------------------------------------------

    def _marks(self, kind: str) -> list[int]:
        return sorted(int(n.removeprefix(f"{kind}=")) for n in files.names(self.spark, f"{self.root}/appends") if n.startswith(f"{kind}="))

    def unfinished(self) -> list[int]:
        """Appends that began and never came to their end."""
        return self._marks("open")

    def sealed(self) -> int:
        """The last append that is logged, as are all before it. 0: none."""
        done, running = self._marks("sealed"), self._marks("open")
        return min([max(done, default=0), *(n - 1 for n in running)])

    def begin(self) -> int:
        """Number of a new append."""
        number = 1 + max([0, *self._marks("sealed"), *self._marks("open")])
        files.make_folder(self.spark, f"{self.root}/appends/open={number}")
        return number

    def seal(self, number: int) -> None:
        """The append's ticks and log entries are all written."""
        here = f"{self.root}/appends"
        files.make_folder(self.spark, f"{here}/sealed={number}")
        files.remove(self.spark, [f"{here}/open={number}"])
        files.remove(self.spark, (f"{here}/sealed={n}" for n in self._marks("sealed") if n < number))

    # -- entries -------------------------------------------------------------------------------

    def add(self, tier: str, rows: DataFrame, name: str | None = None) -> None:
        """One more entry; an entry of the same name is replaced."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{tier}/entry={name or uuid.uuid4().hex}")

    def read(self, tier: str, schema: T.StructType) -> DataFrame | None:
        """All rows logged for a tier, with the entry each is in; None if there is no entry."""
        path = f"{self.root}/{tier}"
        found = [n for n in files.names(self.spark, path) if n.startswith("entry=")]
        if not found:
            return None
        full = T.StructType([*schema.fields, T.StructField("entry", T.StringType())])
        return self.spark.read.schema(full).option("basePath", path).parquet(*(f"{path}/{n}" for n in found))

    def trim(self, tier: str, rows: DataFrame, done) -> None:
        """Take the rows for which ``done`` holds out of the log. What is left of their entries becomes one new entry
        before they go, so a crash in between leaves rows twice and loses none."""
        counts = rows.groupBy("entry").agg(F.count(F.when(done, 1)).alias("done"), F.count(F.lit(1)).alias("n"))
        touched = {r.entry: r.n > r.done for r in counts.filter("done > 0").collect()}  # one row per entry
        if any(touched.values()):
            self.add(tier, rows.filter(F.col("entry").isin([e for e, left in touched.items() if left]) & ~done).drop("entry"))
        self._drop(tier, touched)

    def _drop(self, tier: str, entries: Iterable[str]) -> None:
        files.remove(self.spark, (f"{self.root}/{tier}/entry={e}" for e in entries))
