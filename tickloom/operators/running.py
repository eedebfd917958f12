"""Running values over long ordered groups, spread over many tasks.

A plain window over one trading pair or one feed puts all its rows, perhaps a third of the table, into
one task. Here each group's order is cut into chunks: every chunk is reduced to one row, running
values are carried over that far shorter list, and each chunk is then finished on its own, starting
from what came before it. The result equals the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 250_000
CHUNKS_PER_GROUP = 1024


def chunk_of(order: str, span: int = DEFAULT_CHUNK) -> Column:
    """Chunk number of an integer order column, at most ``span`` positions each (twice that around zero)."""
    return F.expr(f"{order} div {span}L")


def _fold(kind: str, value: Column, order: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    return {"min": F.min, "max": F.max}[kind](value)


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"min": F.min, "max": F.max}[kind](value).over(window)


def _join_carry(kind: str, before: Column, here: Column) -> Column:
    if kind == "last":
        return F.coalesce(here, before)
    return {"min": F.least, "max": F.greatest}[kind](before, here)


def running(
    rows: DataFrame, keys: list[str], order: list[str], chunk: Column, values: dict[str, tuple[str, Column]],
    group: int = CHUNKS_PER_GROUP,
) -> DataFrame:
    """Adds one running column per entry of ``values``: name -> (``last`` | ``min`` | ``max``, value).

    Each covers the group's rows up to and including the current one; nulls are skipped. ``order`` must
    be unique within a group and never null, and ``chunk`` must never decrease along it. Rows are shuffled
    once, by group and chunk, for the join and the window alike. Values are carried over the list of chunks in two
    levels, within ``group`` neighbouring chunk numbers and over those groups, so no task sees a long group's whole list even
    where positions are sparse.
    """
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    chunked = rows.withColumns({"_chunk": chunk, **{f"_in_{n}": v for n, (_, v) in values.items()}})

    totals = chunked.groupBy("_chunk", *keys).agg(
        *(_fold(kind, F.col(f"_in_{n}"), position).alias(f"_all_{n}") for n, (kind, _) in values.items())
    )
    totals = totals.withColumn("_group", F.expr(f"_chunk div {group}"))
    earlier = Window.partitionBy(*keys, "_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = totals.select(
        *keys, "_group", "_chunk",
        *(_over(kind, F.col(f"_all_{n}"), earlier).alias(f"_within_{n}") for n, (kind, _) in values.items()),
    )
    groups = totals.groupBy(*keys, "_group").agg(
        *(_fold(kind, F.col(f"_all_{n}"), F.col("_chunk")).alias(f"_sum_{n}") for n, (kind, _) in values.items())
    )
    former = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        *keys, "_group",
        *(_over(kind, F.col(f"_sum_{n}"), former).alias(f"_former_{n}") for n, (kind, _) in values.items()),
    )
    carried = within.join(groups, [*keys, "_group"]).select(
        *keys, "_chunk",
        *(_join_carry(kind, F.col(f"_former_{n}"), F.col(f"_within_{n}")).alias(f"_before_{n}") for n, (kind, _) in values.items()),
    )

    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row per chunk to look up: hashing that side spares the rows a sort the window cannot use.
    joined = chunked.join(carried.hint("shuffle_hash"), [*keys, "_chunk"], "inner")
    return joined.select(
        *rows.columns,
        *(
            _join_carry(kind, F.col(f"_before_{n}"), _over(kind, F.col(f"_in_{n}"), inside)).alias(n)
            for n, (kind, _) in values.items()
        ),
    )
