"""Readers for landed and live data. Schemas are always declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sizing import broadcast_if_small


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A folder of Parquet files as a stream, from the first file on."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _raw_lines(files: DataFrame, exchange: str) -> DataFrame:
    """One row per line of landed text files. The file is the lane and the line number the position in it, however the
    files are read; the landing file's change time stands for ingest time."""
    lines = files.select(
        F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), "\r?\n")).alias("arrival", "raw"),
        F.col("_metadata.file_path").alias("lane"), F.col("_metadata.file_modification_time").alias("ingest_ts"),
    )
    return lines.select(F.lit(exchange).alias("exchange"), "raw", "lane", F.col("arrival").cast("bigint").alias("arrival"), "ingest_ts")


def _text_blocks(lines: DataFrame) -> DataFrame:
    """Lines with the byte range of the file that brought each: big files come in many."""
    return lines.select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").alias("landed"),
    )


def numbered_lines(blocks: DataFrame, exchange: str, lane: str | None = None, start: int = 0) -> DataFrame:
    """Raw payload rows of the lines of ``text_blocks``: no task holds more than its byte range, no row more than a line.

    Spark numbers the rows within a task in reading order; less the first of the byte range that is the line within the
    range. Ranges are counted, and a line's position is what the ranges before its own hold. So positions are
    the same however a file is split. Without a ``lane`` each file is one, numbered from 0. With one, all files make it up,
    in the order in which they landed, numbered from ``start`` on.
    """
    marked = blocks.withColumn("_row", F.monotonically_increasing_id())
    ranges = marked.groupBy("file", "block", "landed").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_file = ranges.groupBy("file", "landed").agg(F.sum("_n").alias("_lines"))  # a row for each file
    if lane is None:
        before = of_file.select("file", F.lit(0).cast("bigint").alias("_before"))
    else:
        landed = Window.orderBy("landed", "file").rowsBetween(Window.unboundedPreceding, -1)
        before = of_file.select("file", (F.coalesce(F.sum("_lines").over(landed), F.lit(0)) + start).alias("_before"))
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) - F.col("_first")
    offsets = ranges.join(before, "file").select("file", "block", offset.alias("_offset"))
    rows = marked.join(broadcast_if_small(offsets), ["file", "block"])
    return rows.select(
        F.lit(exchange).alias("exchange"), F.regexp_replace("value", r"\r\z", "").alias("raw"),
        (F.col("file") if lane is None else F.lit(lane)).alias("lane"),
        (F.col("_row") + F.col("_offset")).alias("arrival"), F.col("landed").alias("ingest_ts"),
    )


def read_raw_text(spark: SparkSession, path: str, exchange: str, lane: str | None = None) -> DataFrame:
    """Landed raw messages, one JSON text per line, in the raw payload layout. Files are read in byte ranges."""
    return numbered_lines(_text_blocks(spark.read.text(path, lineSep="\n")), exchange, lane)


def stream_text_blocks(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The lines of landed files as a stream, for ``numbered_lines`` within a micro-batch (``jobs.LandedLines``)."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _text_blocks(reader.text(path))


def stream_raw_text(spark: SparkSession, path: str, exchange: str, files_per_batch: int | None = None) -> DataFrame:
    """``read_raw_text`` as one plain stream over the files of a folder, each file a lane. A file passes through one row here, so
    it must be well below 2 GB; ``jobs.LandedLines`` has no such limit."""
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _raw_lines(reader.text(path, wholetext=True), exchange)


def kafka_options(servers: str, topic: str, max_offsets: int | None = None) -> dict[str, str]:
    """Options of a topic read from its start."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}
    if max_offsets is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def stream_kafka(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Key, value, lane (partition), arrival (offset) and record time. Needs Spark's Kafka package on the
    class path, which is not part of a plain PySpark install."""
    return kafka_records(spark.readStream.format("kafka").options(**options).load())


def kafka_records(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("key").cast("string").alias("key"), "value", F.col("partition").cast("string").alias("lane"),
        F.col("offset").alias("arrival"), F.col("timestamp").alias("ingest_ts"),
    )


def raw_from_kafka(records: DataFrame, exchange: str) -> DataFrame:
    return records.select(
        F.lit(exchange).alias("exchange"), F.col("value").cast("string").alias("raw"), "lane", "arrival", "ingest_ts"
    )
