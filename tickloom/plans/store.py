"""The tables on disk: ticks and tiers, their layout, appends, refreshes and retention.

Ticks lie in folders by day and slice: some hours of a hash group of pairs. An append looks only into the slices its batch
touches. What it adds is logged (``changes``), and a refresh folds that into the points it belongs to, without
reading ticks again. ``rebuild_tier`` recomputes a range whatever the log says.
"""

from __future__ import annotations

import calendar
import zlib
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from ..functions.clock import as_utc, bucket_start, ts_literal
from ..operators.ohlc import KEYS, OHLC_COLUMNS, STATE_COLUMNS, merge_states
from ..operators.sizing import BROADCAST_BYTES
from ..operators.ticks import TICK_COLUMNS, TICK_KEY, first_copies, within
from ..schemas import TICK
from .changes import STATE, TOUCHED, ChangeLog
from .tiers import RETENTION_MONTHS, TIERS, Tier, check_policy, children, refresh_order

# Number of hash groups of pairs; the lengths of a slice, in hours, that part a day evenly.
PAIR_BUCKETS = 4
SLICE_HOURS = (1, 2, 3, 4, 6, 8, 12, 24)
# Folder column of a tier -> its date format, in Spark's and in Python's notation.
_FOLDERS = {"hour": ("yyyy-MM-dd-HH", "%Y-%m-%d-%H"), "date": ("yyyy-MM-dd", "%Y-%m-%d"), "month": ("yyyy-MM", "%Y-%m"), "year": ("yyyy", "%Y")}

# ``seq`` is the append that wrote the tick. ``pair_bucket`` numbers the slices of a day; tables written before there were
# hours in it hold 0 to PAIR_BUCKETS - 1 alone, which are the slices of no hour.
TICKS_ON_DISK = T.StructType([
    *TICK.fields, T.StructField("seq", T.LongType()), T.StructField("date", T.StringType()),
    T.StructField("pair_bucket", T.IntegerType()),
])


def pair_bucket(pair: Column) -> Column:
    return F.pmod(F.crc32(pair), F.lit(PAIR_BUCKETS)).cast("int")


def slice_of(time: Column, pair: Column, hours: int) -> Column:
    """Slice of the day: the hour it begins with and the group of pairs."""
    hour = F.hour(time.cast("timestamp"))
    return ((hour - hour % hours + 1) * PAIR_BUCKETS + pair_bucket(pair)).cast("int")


def pair_bucket_of(pair: str) -> int:
    return zlib.crc32(pair.encode()) % PAIR_BUCKETS


def retention_cutoff(now: datetime) -> date:
    """First day kept: only days that lie whole before ``now`` minus the retention are dropped."""
    now = as_utc(now)
    months = now.year * 12 + now.month - 1 - RETENTION_MONTHS
    year, month = divmod(months, 12)
    return date(year, month + 1, min(now.day, calendar.monthrange(year, month + 1)[1]))


def retained(ticks: DataFrame, now: datetime) -> DataFrame:
    """The ticks retention leaves: everything from the first kept day on."""
    like = dict(ticks.dtypes)["time"]
    first = retention_cutoff(now)
    return ticks.filter(F.col("time") >= ts_literal(datetime(first.year, first.month, first.day), like))


@dataclass(frozen=True)
class TickStore:
    """Tables below one folder all executors reach.

    ``slice_hours`` sets the folders of new ticks: a whole day suits some million ticks a day, one hour far more. It
    may change between appends: a folder's number says which hour it begins with, and readers look for every length.
    """

    spark: SparkSession
    root: str
    slice_hours: int = 24

    def __post_init__(self):
        if self.slice_hours not in SLICE_HOURS:
            raise ValueError(f"slice_hours must be one of {SLICE_HOURS}")

    # -- ticks ---------------------------------------------------------------------------------

    @property
    def ticks_path(self) -> str:
        return f"{self.root}/ticks"

    def _read(self, path: str, schema) -> DataFrame:
        if not files.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def read_ticks(
        self, start: datetime | None = None, end: datetime | None = None, pair: str | None = None
    ) -> DataFrame:
        """Ticks with ``start <= time < end``; day and pair-bucket folders outside are not opened."""
        ticks = self._read(self.ticks_path, TICKS_ON_DISK)
        if start is not None:
            ticks = ticks.filter(
                (F.col("date") >= as_utc(start).strftime("%Y-%m-%d")) & (F.col("time") >= ts_literal(start))
            )
        if end is not None:
            ticks = ticks.filter(
                (F.col("date") <= as_utc(end).strftime("%Y-%m-%d")) & (F.col("time") < ts_literal(end))
            )
        if pair is not None:
            ticks = ticks.filter((F.col("pair_bucket") % PAIR_BUCKETS == pair_bucket_of(pair)) & (F.col("crypto_pair") == pair))
        return ticks.select(*TICK_COLUMNS)

    def _slices(self, batch: DataFrame) -> DataFrame:
        """The slices that may hold ticks of the batch's hours and pairs: a few per hour and group, whatever its size, as
        each length gives one and tables written before there were hours another."""
        hour, group = F.hour(F.col("time").cast("timestamp")), pair_bucket(F.col("crypto_pair"))
        touched = batch.select(F.date_format("time", "yyyy-MM-dd").alias("date"), hour.alias("hour"), group.alias("group")).distinct()
        begins = F.array(*((F.col("hour") - F.col("hour") % n + 1) * PAIR_BUCKETS + F.col("group") for n in SLICE_HOURS), F.col("group"))
        rows = touched.select("date", F.explode(begins.cast("array<int>")).alias("pair_bucket")).distinct()
        return rows.filter(F.col("date") >= "")  # a condition of its own lets Spark prune folders by this side

    def _in_slices(self, ticks: DataFrame, slices: DataFrame) -> DataFrame:
        """Ticks on disk in the given slices. A day has some hundreds of them, so the list is broadcast, unless a batch spans
        more days than fit; folders it does not name are not opened."""
        rows = slices.count()
        slices = F.broadcast(slices) if rows * 64 <= BROADCAST_BYTES else slices
        return ticks.join(slices, ["date", "pair_bucket"], "left_semi")

    def _stored_beside(self, batch: DataFrame) -> DataFrame:
        """Stored ticks in the slices of the batch, between its first and last time. The time is part of the key, so no other
        can match: one tick of last month costs one more slice, not the month."""
        low, high = batch.agg(*(f("time").cast("timestamp").cast("string") for f in (F.min, F.max))).first()
        stored = self._read(self.ticks_path, TICKS_ON_DISK)
        if low is None:
            return stored.limit(0)
        stored = stored.filter(
            F.col("date").between(low[:10], high[:10])
            & F.col("time").between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")))
        return self._in_slices(stored, self._slices(batch))

    @property
    def log(self) -> ChangeLog:
        return ChangeLog(self.spark, f"{self.root}/changes")

    def append_ticks(self, batch: DataFrame, order: str = "arrival") -> None:
        """Add the ticks of a batch whose key is not stored yet. Running it again adds nothing.

        The batch is worked out once. The rebalance hint sizes files by data, cutting a hot day or pair into several, which a
        fixed number of writers per pair would not. A null time is no tick of any day and is left out.
        """
        for number in self.log.unfinished():
            self._log_append(number)
        with files.staged(first_copies(batch.filter(F.col("time").isNotNull()), order).select(*TICK_COLUMNS)) as first:
            number = self.log.begin()
            fresh = first.join(self._stored_beside(first).select(*TICK_KEY), TICK_KEY, "left_anti")
            (
                fresh.withColumns({
                    "seq": F.lit(number).cast("bigint"), "date": F.date_format("time", "yyyy-MM-dd"),
                    "pair_bucket": slice_of(F.col("time"), F.col("crypto_pair"), self.slice_hours),
                }).hint("rebalance", "date", "pair_bucket")
                .sortWithinPartitions("date", "pair_bucket", "crypto_pair", "exchange", F.col("time").desc())
                .write.mode("append").partitionBy("date", "pair_bucket").parquet(self.ticks_path)
            )
            self._log_append(number, first)

    def _log_append(self, number: int, batch: DataFrame | None = None) -> None:
        """Log what the append wrote, as read back from its own files: the number's range in each file tells them apart. Without
        its batch (the append died) all folders are looked through."""
        ticks = self._read(self.ticks_path, TICKS_ON_DISK).filter(F.col("seq") == number)
        if batch is not None:
            ticks = self._in_slices(ticks, self._slices(batch))
        for tier in children("ticks"):
            self.log.add(tier.name, tier.states(ticks).withColumn("seq", F.lit(number).cast("bigint")), str(number))
        self.log.seal(number)

    def apply_retention(self, now: datetime) -> list[str]:
        """Drop the day folders that lie whole before the retention limit; returns their names.

        Only folder names pass through the driver. Tiers are never touched.
        """
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.ticks_path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        first_kept = retention_cutoff(now).isoformat()
        dropped = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("date=") and name[len("date="):] < first_kept:
                fs.delete(status.getPath(), True)
                dropped.append(name)
        return sorted(dropped)

    # -- tiers ---------------------------------------------------------------------------------

    def tier_path(self, tier: Tier) -> str:
        return f"{self.root}/ohlc_{tier.name}"

    def read_tier(self, tier: Tier, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Points with ``start <= bucket <= end``; folders outside are not opened."""
        points = self._tier_on_disk(tier)
        fmt = _FOLDERS[tier.partition][1]
        if start is not None:
            points = points.filter(
                (F.col(tier.partition) >= as_utc(start).strftime(fmt)) & (F.col("bucket") >= ts_literal(start))
            )
        if end is not None:
            points = points.filter(
                (F.col(tier.partition) <= as_utc(end).strftime(fmt)) & (F.col("bucket") <= ts_literal(end))
            )
        return points.select(*OHLC_COLUMNS)

    def _tier_on_disk(self, tier: Tier) -> DataFrame:
        return self._read(self.tier_path(tier), T.StructType([*STATE.fields, T.StructField(tier.partition, T.StringType())]))

    def _states(self, tier: Tier, start: datetime, end: datetime, upto: int) -> DataFrame:
        """States of the buckets in ``[start, end)`` from the tier's whole source, ticks up to append ``upto``."""
        if tier.source == "ticks":
            ticks = self._read(self.ticks_path, TICKS_ON_DISK)
            ticks = ticks.filter(F.col("date").between(start.strftime("%Y-%m-%d"), end.strftime("%Y-%m-%d")))
            ticks = ticks.filter(within(F.col("time"), ts_literal(start), ts_literal(end)) & (F.coalesce("seq", F.lit(0)) <= upto))
            return tier.states(ticks)
        parent = TIERS[tier.source]
        fmt = _FOLDERS[parent.partition][1]
        points = self._tier_on_disk(parent).filter(F.col(parent.partition).between(start.strftime(fmt), end.strftime(fmt)))
        return tier.states(points.filter(within(F.col("bucket"), ts_literal(start), ts_literal(end))))

    def refresh_rollup(self, tier_name: str, now: datetime) -> tuple[datetime, datetime]:
        """Bring the complete buckets of a tier's refresh range up to date: those that changed, and only those."""
        tier = TIERS[tier_name]
        start, end = tier.refresh_range(now)
        if end > start:
            (self._fold if tier.source == "ticks" else self._recompute)(tier, start, end)
        return start, end

    def _fold(self, tier: Tier, start: datetime, end: datetime) -> None:
        """Merge the logged states of the range into the stored points. Ticks are not read."""
        rows = self.log.read(tier.name, STATE)
        if rows is None:
            return
        due = within(F.col("bucket"), ts_literal(start), ts_literal(end)) & (F.col("seq") <= self.log.sealed())
        states = rows.filter(due).drop("entry").dropDuplicates([*KEYS, "seq"])
        touched = self._folders(tier, states)
        if not touched:
            return
        former = self._tier_on_disk(tier).filter(F.col(tier.partition).isin(touched)).select(*STATE_COLUMNS, "seq")
        before = former.select(*KEYS, F.col("seq").alias("_before"))
        new = states.join(before, KEYS, "left").filter(F.col("_before").isNull() | (F.col("seq") > F.col("_before"))).drop("_before")
        both = former.unionByName(new)
        last = both.groupBy(*KEYS).agg(F.max("seq").alias("seq"))
        self._replace(tier, merge_states(both).join(last, KEYS))
        self._tell_children(tier, states)
        self.log.trim(tier.name, rows, due)

    def _recompute(self, tier: Tier, start: datetime, end: datetime) -> None:
        """Recompute the logged buckets of the range from the points of the tier below them."""
        rows = self.log.read(tier.name, TOUCHED)
        if rows is None:
            return
        due = within(F.col("bucket"), ts_literal(start), ts_literal(end))
        keys = rows.filter(due).select(*KEYS).distinct()
        touched = self._folders(tier, keys)
        if not touched:
            return
        first, last = (as_utc(datetime.fromisoformat(x)) for x in keys.agg(*(
            f("bucket").cast("timestamp").cast("string") for f in (F.min, F.max))).first())
        parent = TIERS[tier.source]
        fmt = _FOLDERS[parent.partition][1]
        points = self._tier_on_disk(parent).filter(F.col(parent.partition).between(first.strftime(fmt), (last + tier.bucket).strftime(fmt)))
        coarse = bucket_start(F.col("bucket"), tier.bucket, tier.bucket_offset)
        wanted = keys.withColumnRenamed("bucket", "_coarse")
        points = points.withColumn("_coarse", coarse).join(wanted, ["_coarse", "exchange", "crypto_pair"], "left_semi")
        fresh = tier.states(points).withColumn("seq", F.lit(None).cast("bigint"))
        former = self._tier_on_disk(tier).filter(F.col(tier.partition).isin(touched)).select(*STATE_COLUMNS, "seq")
        self._replace(tier, former.join(keys, KEYS, "left_anti").unionByName(fresh))
        self._tell_children(tier, keys)
        self.log.trim(tier.name, rows, due)

    def _folder(self, tier: Tier) -> Column:
        return F.date_format("bucket", _FOLDERS[tier.partition][0])

    def _folders(self, tier: Tier, rows: DataFrame) -> list[str]:
        """Names of the folders the rows' buckets are in: one short row per folder of a refresh range."""
        return sorted(r[0] for r in rows.select(self._folder(tier)).distinct().collect())

    def _tell_children(self, tier: Tier, changed: DataFrame) -> None:
        """Log the buckets of the next tiers that hold changed buckets of this one."""
        for child in children(tier.name):
            bucket = bucket_start(F.col("bucket"), child.bucket, child.bucket_offset).alias("bucket")
            self.log.add(child.name, changed.select(bucket, "exchange", "crypto_pair").distinct())

    def rebuild_tier(self, tier_name: str, start: datetime, end: datetime) -> None:
        """Recompute the buckets in ``[start, end)`` from the tier's source.

        Buckets of a touched folder outside the range are written back as they are. Only folders whose points change
        are written, and a touched folder that no point is left for is removed, so a bucket whose ticks are gone
        is gone too; the job may run again at any point.
        """
        tier = TIERS[tier_name]
        fmt = _FOLDERS[tier.partition][1]
        last = end - timedelta(microseconds=1)
        touched = F.col(tier.partition).between(start.strftime(fmt), last.strftime(fmt))
        upto = self.log.sealed()
        columns = [*STATE_COLUMNS, "seq"]
        former = self._tier_on_disk(tier).filter(touched)
        in_range = within(F.col("bucket"), ts_literal(start), ts_literal(end))
        fresh = self._states(tier, start, end, upto).withColumn("seq", F.lit(upto if tier.source == "ticks" else None).cast("bigint"))
        rows = fresh.select(*columns).unionByName(former.filter(~in_range).select(*columns)).withColumn(tier.partition, self._folder(tier))
        with files.staged(rows) as rows:  # compared, then written
            # one short row per folder of the range passes through the driver
            stamp = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*OHLC_COLUMNS).cast("decimal(38,0)")).alias("h")]
            new = {r[0]: tuple(r[1:]) for r in rows.groupBy(tier.partition).agg(*stamp).collect()}
            old = {r[0]: tuple(r[1:]) for r in former.groupBy(tier.partition).agg(*stamp).collect()}
            changed = sorted(f for f in {*new, *old} if new.get(f) != old.get(f))
            if not changed:
                return
            moved = rows.filter(F.col(tier.partition).isin(changed) & in_range).select(*KEYS)
            gone = former.filter(F.col(tier.partition).isin(changed) & in_range).select(*KEYS)
            with files.staged(moved.unionByName(gone).distinct()) as keys:
                self._write_folders(tier, rows.filter(F.col(tier.partition).isin(changed)))
                files.remove(self.spark, (f"{self.tier_path(tier)}/{tier.partition}={f}" for f in old if f not in new))
                self._tell_children(tier, keys)

    def _replace(self, tier: Tier, points: DataFrame) -> None:
        with files.staged(points.withColumn(tier.partition, self._folder(tier))) as rows:  # reads what it replaces
            self._write_folders(tier, rows)

    def _write_folders(self, tier: Tier, rows: DataFrame) -> None:
        """Replace the folders. Spark stages all new files before it removes the old ones."""
        (
            rows.hint("rebalance", tier.partition)
            .sortWithinPartitions(tier.partition, "crypto_pair", "exchange", "bucket")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(tier.partition).parquet(self.tier_path(tier))
        )

    def refresh_all(self, now: datetime) -> None:
        """Refresh every tier, sources first."""
        check_policy()
        for name in refresh_order():
            self.refresh_rollup(name, now)
