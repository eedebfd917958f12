"""Evaluate a costly expression once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with ``value`` as column ``name``, computed before anything that uses it.

    The optimizer copies a column's expression into every later filter and projection that mentions it,
    which multiplies for nested parsing steps. It leaves alone what depends on where a row is worked on, and the
    partition's number, which is never negative, costs nothing to ask for. Unlike an explode of a one-element array, the
    projection is generated code even where a branch of ``value`` holds an interpreted lambda.
    """
    return rows.withColumn(name, F.when(F.spark_partition_id() >= 0, value))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often the body mentions it."""
    return F.transform(F.array(value), body)[0]
