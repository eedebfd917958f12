"""The roll-up tiers, their refresh policy, and the choice of a tier for a time range."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from ..functions.clock import as_utc, micros
from ..operators.ohlc import merge_states, ohlc_from_tier, ohlc_from_ticks, states_from_ticks

MINUTE, HALF_HOUR, HOUR, DAY = (
    timedelta(minutes=1), timedelta(minutes=30), timedelta(hours=1), timedelta(days=1),
)
WEEK = timedelta(days=7)
# Buckets count from the epoch, a Thursday; weeks are to start on Mondays.
MONDAY = timedelta(days=4)


@dataclass(frozen=True)
class Tier:
    name: str
    source: str
    bucket: timedelta
    start_offset: timedelta
    end_offset: timedelta
    every: timedelta
    # Folder column of the table. A folder never splits a bucket.
    partition: str
    bucket_offset: timedelta = timedelta(0)

    def build(self, source: DataFrame) -> DataFrame:
        if self.source == "ticks":
            return ohlc_from_ticks(source, self.bucket)
        return ohlc_from_tier(source, self.bucket, self.bucket_offset)

    def states(self, source: DataFrame) -> DataFrame:
        """``build``, as points that can be merged further."""
        if self.source == "ticks":
            return states_from_ticks(source, self.bucket)
        return merge_states(source, self.bucket, self.bucket_offset)

    def refresh_range(self, now: datetime) -> tuple[datetime, datetime]:
        """The complete buckets inside ``[now - start_offset, now - end_offset]`` as ``[first, end)``."""
        return (
            self.floor(as_utc(now) - self.start_offset + self.bucket - timedelta(microseconds=1)),
            self.floor(as_utc(now) - self.end_offset),
        )

    def floor(self, moment: datetime) -> datetime:
        """Start of the bucket holding ``moment``."""
        epoch = as_utc(datetime(1970, 1, 1)) + self.bucket_offset
        return moment - timedelta(microseconds=micros(moment - epoch) % micros(self.bucket))


# Bucket width and refresh policy of each tier; the weekly tier is described without a
# schedule apart from its end offset.
TIERS = {
    t.name: t
    for t in (
        Tier("minute", "ticks", MINUTE, timedelta(minutes=30), timedelta(minutes=1), timedelta(minutes=1), "hour"),
        Tier("30min", "minute", HALF_HOUR, timedelta(hours=3), timedelta(minutes=5), timedelta(minutes=5), "date"),
        Tier("hourly", "ticks", HOUR, timedelta(hours=3), timedelta(minutes=10), timedelta(minutes=10), "date"),
        Tier("daily", "hourly", DAY, timedelta(days=3), timedelta(hours=1), timedelta(hours=1), "month"),
        Tier("weekly", "daily", WEEK, timedelta(days=21), timedelta(days=1), timedelta(days=1), "month", MONDAY),
    )
}

# Raw ticks are kept one month; a chart holds at most this many points.
RETENTION_MONTHS = 1
MAX_POINTS = 750
# Tiers a chart may use, finest first.
CHART_TIERS = ["minute", "30min", "hourly", "daily"]


def refresh_order() -> list[str]:
    """Tier names with every source before the tier built from it."""
    ordered: list[str] = []
    while len(ordered) < len(TIERS):
        ordered += [
            t.name for t in TIERS.values()
            if t.name not in ordered and (t.source == "ticks" or t.source in ordered)
        ]
    return ordered


def children(name: str) -> list[Tier]:
    """The tiers built from a tier, or from the ticks."""
    return [t for t in TIERS.values() if t.source == name]


def check_policy() -> None:
    """A tier waits longer than its source, and looks back less far than raw ticks are kept."""
    for tier in TIERS.values():
        if tier.source != "ticks" and tier.end_offset <= TIERS[tier.source].end_offset:
            raise ValueError(f"{tier.name} would read unfinished buckets of {tier.source}")
        if tier.source == "ticks" and tier.start_offset >= timedelta(days=28 * RETENTION_MONTHS):
            raise ValueError(f"{tier.name} would be rebuilt from ticks already dropped")


def select_tier(start: datetime, end: datetime) -> Tier:
    """The finest tier whose whole buckets in the range fit the point budget, else daily."""
    span = as_utc(end) - as_utc(start)
    for name in CHART_TIERS:
        if span // TIERS[name].bucket <= MAX_POINTS:
            return TIERS[name]
    return TIERS[CHART_TIERS[-1]]
