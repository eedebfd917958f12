"""Writers: one folder per run and micro-batch, labelled logs, and keyed message-bus records.

A run is one stream with its checkpoint. Batch numbers start over with a new checkpoint, so the run is part of the path:
what an earlier run wrote stays, and only a batch that runs again within its run replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from ..operators.monitor import LABELS

DIRECT = "direct"


def run_of(rows: DataFrame) -> str:
    """Name of the run a micro-batch belongs to: the id that the stream's checkpoint keeps. Rows written outside any
    stream belong to the run ``direct``."""
    return rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or DIRECT


def run_path(rows: DataFrame, path: str, run: str | None = None) -> str:
    return f"{path}/run={run or run_of(rows)}"


def batch_path(rows: DataFrame, path: str, batch_id: int | str, run: str | None = None) -> str:
    """Folder of one micro-batch of a run."""
    return f"{run_path(rows, path, run)}/batch_id={batch_id}"


def drop_batches(spark: SparkSession, run_folder: str, unwanted: Callable[[int], bool]) -> None:
    """Remove the folders of the batches that ``unwanted`` names, in one run. For state that later batches replace: outputs
    are never dropped. Only folder names pass through the driver."""
    for name in files.names(spark, run_folder):
        if name.startswith("batch_id=") and unwanted(int(name.removeprefix("batch_id="))):
            files.remove(spark, [f"{run_folder}/{name}"])


def write_micro_batch(
    rows: DataFrame, path: str, batch_id: int, run: str | None = None, once_by: list[str] | None = None
) -> None:
    """One folder per run and micro-batch, replaced whole: a batch that runs again leaves no second copy.

    With ``once_by`` rows whose key another run has written are left out, so a run that reads the source anew adds none of
    them again. For outputs that stay small, as each batch of such a run reads the others' keys; a first run reads nothing.
    """
    if once_by is not None:
        mine = f"run={run or run_of(rows)}"
        others = [n for n in files.names(rows.sparkSession, path) if n.startswith("run=") and n != mine]
        if others:
            known = rows.sparkSession.read.schema(rows.schema).parquet(*(f"{path}/{n}" for n in others))
            known = known.select(*(F.col(k).alias(f"_{k}") for k in once_by))
            rows = rows.join(known, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in once_by], "left_anti")
    rows.write.mode("overwrite").parquet(batch_path(rows, path, batch_id, run))


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType, keys: list[str] | None = None
) -> DataFrame:
    """Rows of all runs and batches below ``path``; none if nothing was written.

    A run with a new checkpoint may read its source again and write rows a second time. With ``keys`` one row of each
    key is kept, from the run and batch that come first by name.
    """
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(full).parquet(path)
    if keys is not None:
        first = Window.partitionBy(*keys).orderBy("run", "batch_id")
        rows = rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    return rows.select(*(f.name for f in schema.fields))


def write_labelled_logs(lines: DataFrame, path: str, batch_id: int | None = None, run: str | None = None) -> None:
    """Log lines of one batch in folders by the few indexed labels; the batch's folder is replaced whole. Without a batch
    number the lines name their folder themselves, so only the same lines again replace it. The rebalance hint splits a
    label that most lines share."""
    rows = lines.withColumn("metadata", F.to_json("metadata"))
    if batch_id is None:
        n, stamp = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
        batch_id = f"{n}_{int(stamp or 0) % (1 << 64):016x}"
    (
        rows.hint("rebalance", *LABELS).write.mode("overwrite").partitionBy(*LABELS)
        .json(batch_path(lines, path, batch_id, run))
    )


def keyed_records(rows: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Key and value for a message bus: equal keys share a partition, which keeps their order."""
    return rows.select(F.col(key).cast("string").alias("key"), F.col(value).alias("value")).repartition("key")
