"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..session import use_checkpoints

SLICE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = "".join(chr(c) for c in (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lowered; none in a null text."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + _GAPS, LOWER + " " * len(_GAPS))
    return F.array_remove(F.split(plain, " "), "")


def with_field(schema: StructType, name: str, kind: str) -> StructType:
    """A new schema; ``StructType.add`` would change the one that a DataFrame keeps."""
    return StructType(list(schema.fields)).add(name, DataType.fromDDL(kind))


#: Longest text that a model is fitted on.
FIT_BYTES = 1 << 16


def one_text_each(docs: DataFrame, picked: DataFrame, label: str) -> DataFrame:
    """text and label of each picked document (doc_id, label; a bounded number): one row per doc_id, of several that with the
    smallest text hash. Texts of more than ``FIT_BYTES`` bytes are not learnt from, so what the driver gets is bounded."""
    rows = docs.select("doc_id", "text").filter(F.col("text").isNull() | (F.octet_length("text") <= FIT_BYTES))
    rows = rows.join(F.broadcast(picked), "doc_id")
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", label), F.struct(F.xxhash64("text"), "text")).alias("_one"))
    return first.select("_one.text", f"_one.{label}")


#: What a Python worker keeps for further tasks of the stage it is in.
_KEPT: dict[tuple, object] = {}


def forget_other_stages() -> int | None:
    """Drops what the worker kept for another stage, as Spark reuses workers from stage to stage; the stage it is in."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if old := [k for k in _KEPT if k[0] != stage]:
        for key in old:
            del _KEPT[key]
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it, and only there freed memory stays with the process
            ctypes.CDLL(None).malloc_trim(0)
    return stage


def kept_in_stage(make: Callable, *args):
    """``make(*args)``, made once by each Python worker for all its tasks of one stage."""
    key = (forget_other_stages(), make, *args)
    if key not in _KEPT:
        _KEPT[key] = make(*args)
    return _KEPT[key]


def map_batches(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``work`` on every Arrow batch, in slices of ``SLICE`` rows so that what a worker holds beside the batch stays
    small; slices without an answer give no rows. A task begins without what other stages left in its worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = work(batch.slice(at, SLICE))
                if out is not None and out.num_rows:
                    yield out

    return rows.mapInArrow(run, schema)


def portions(text: bytes, gap: re.Pattern[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes, each cut after a match of ``gap``, so that no word is cut."""
    at = 0
    while len(text) - at > size and (found := gap.search(text, at + size)):
        yield text[at:found.end()]
        at = found.end()
    yield text[at:]


def grouped(batches: Iterator[pa.RecordBatch], key: str, at_least: int) -> Iterator[pa.Table]:
    """Tables of about ``at_least`` rows that never cut a run of equal ``key`` values.

    The rows must arrive sorted by ``key``. What is held is bounded by ``at_least``, one Arrow batch and one run.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < at_least:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield whole.slice(0, cut)
            held = whole.slice(cut).combine_chunks().to_batches()
            size = whole.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written once as Parquet below the shared checkpoint folder, and read from there.

    Unlike a checkpoint, the result has no known partitioning, so a join on it shuffles both sides plainly and
    AQE may split a hot key.
    """
    spark = rows.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a, b): columns node, component.

    Alternates the large-star and small-star steps: every node's neighbours are hung on its smallest neighbour
    until no edge changes. Each step aggregates before it shuffles and keeps no list per node.
    """
    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # oriented: a is larger than b
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = stamp(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # keep an edge's larger end, hung on the smallest node around its smaller or larger end
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct())
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionAll(least.select("a", F.col("m").alias("b")))
        edges = stored(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        after = stamp(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def cells(keyed: DataFrame, key: str, row: str, limit: int, weight: Column | None = None) -> DataFrame:
    """Rows of keys that hold at least two rows, dealt to cells of at most about ``2 * limit`` rows: adds cell, part.

    With a ``weight`` the limit is one of summed weights. A key of up to ``limit`` rows is one cell. A larger key is cut into parts by a hash of ``row``, and every two
    parts meet in one cell, so each pair of rows of a key meets in some cell; within a cell of two parts only
    rows of different ``part`` need comparing.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = stored(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), size.alias("_size")).filter("_n > 1"))
    parts = F.least(F.ceil(F.col("_size") / limit), F.col("_n")).cast("int")
    mine = F.pmod(F.xxhash64(row, F.lit(7)), parts).cast("int")
    dealt = keyed.join(counts, key).withColumn("part", mine) \
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumn("cell", F.xxhash64(key, F.least("part", "_other"), F.greatest("part", "_other"))) \
        .withColumn("part", F.when(F.col("part") == F.col("_other"), F.lit(-1)).otherwise(F.col("part"))) \
        .drop("_n", "_size", "_other")


def cell_pairs(cell: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers to compare, from rows sorted by cell: all at distance 1, then 2, and so on."""
    at = np.arange(len(cell))
    d = 1
    while True:
        at = at[at + d < len(cell)]
        at = at[cell[at] == cell[at + d]]
        if not len(at):
            return
        use = at[(part[at] < 0) | (part[at] != part[at + d])]
        yield use, use + d
        d += 1


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of ``n`` rows by the links a-b."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, old):
            return root
