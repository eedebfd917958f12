"""Folders on whatever file system Spark reaches: names, removal, and rows kept aside for one piece of work."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .session import shared_dir


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _at(spark, path)
    return fs.exists(hadoop)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names right below ``path``, sorted; none if there is no such folder."""
    fs, hadoop = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def make_folder(spark: SparkSession, path: str) -> None:
    fs, hadoop = _at(spark, path)
    fs.mkdirs(hadoop)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        fs, hadoop = _at(spark, path)
        fs.delete(hadoop, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Whether ``old`` is ``new`` now. On the file systems Spark writes to this is one step for one folder."""
    fs, hadoop = _at(spark, old)
    return fs.rename(hadoop, _at(spark, new)[1])


@contextmanager
def staged(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` written once to the shared folder and read from there; removed when the work is done.

    Unlike a cache the rows outlive an executor, and unlike a checkpoint they do not stay behind.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(path)
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        remove(spark, [path])
