"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

A fingerprint is cut into six blocks. Four differing bits touch at most four of them, so two close fingerprints
agree on two whole blocks: the join key is one of the 15 choices of two blocks with their bits. Rows of a key meet in
cells of bounded size (``common.cells``), where Hamming distances are verified; a cell sends on one link per row it
joined, never its pairs.

A key above ``DENSE`` fingerprints would need many cells. Its fingerprints are linked in the other exact way
instead: two fingerprints differ in at most four bits exactly if some value differs from both in at most two, so
all that reach one such middle value are linked to the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cell_pairs, cells, components, grouped, local_roots, map_batches, stored, with_field

SHINGLE, BITS, SEED = 4, 4, 42
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit, width
CELL, DENSE, STRIDE = 512, 20_000, 1 << 16


def fingerprint(text: bytes | None) -> int:
    """SimHash of the text's shingles; 0 if it has no words. Long texts are hashed in strides of bounded size."""
    words = (text or b"").lower().split()  # on bytes: A-Z alone is lowered, and ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STRIDE):
        to = min(n, at + STRIDE)
        first, last = start[at:to].tolist(), end[min(SHINGLE, len(words)) - 1:][at:to].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number, one row per row of ``docs``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_batches(rows, work, with_field(rows.select("doc_id").schema, "fp", "long"))


def _masks() -> list[int]:
    masks = []
    for i, j in combinations(range(len(BLOCKS)), 2):
        mask = sum(((1 << width) - 1) << first for first, width in (BLOCKS[i], BLOCKS[j]))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _near_values() -> list[int]:
    """All 64-bit values with at most two set bits, as signed numbers."""
    values = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in grouped(batches, "cell", 20_000):
        fp, cell, part = (rows.column(c).to_numpy() for c in ("fp", "cell", "part"))
        near = [(a[ok], b[ok]) for a, b in cell_pairs(cell, part)
                if (ok := np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= BITS).any()]
        if near:
            a, b = (np.concatenate(x) for x in zip(*near))
            root = local_roots(len(fp), a, b)
            joined = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[joined]), pa.array(fp[root[joined]])], ["a", "b"])


def links(distinct: DataFrame, cell: int = CELL, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between fingerprints that connect exactly those reachable by steps of up to four bits."""
    mask = F.explode(F.array(*map(F.lit, _masks())))
    keyed = distinct.select("fp", mask.alias("mask"))
    keyed = keyed.select("fp", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    crowded = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > dense).select("key"))
    if crowded.isEmpty():
        sparse, found = keyed, None
    else:
        sparse = keyed.join(crowded, "key", "left_anti")
        hot = stored(keyed.join(crowded, "key", "left_semi").select("fp").distinct())
        middle = hot.select("fp", F.explode(F.array(*map(F.lit, _near_values()))).alias("v"))
        middle = middle.select("fp", F.col("fp").bitwiseXOR(F.col("v")).alias("middle"))
        least = stored(middle.groupBy("middle").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
        found = middle.join(least, "middle").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    dealt = cells(sparse, "key", "fp", cell).select("cell", "part", "fp")
    near = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verify, "a long, b long")
    return near if found is None else near.unionAll(found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) for every row of ``docs``.

    Null, empty and white texts have fingerprint 0 and are near each other. Rows that repeat a doc_id stay apart as
    rows. A null doc_id is smallest only where its whole component has no other. Other columns are ignored. No
    rows give no rows.
    """
    prints = stored(fingerprints(docs))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    joined = stored(components(links(distinct)))
    member = joined.withColumnRenamed("node", "fp").join(distinct, "fp")
    first = member.groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = joined.withColumnRenamed("node", "fp").join(first, "component").select("fp", "least_id")
    named = stored(distinct.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
