"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference vectors (pivots). Two vectors are candidates if they share at least
``SHARED`` of their ``NEAREST`` pivots: then, and only then, they meet under some choice of ``SHARED`` pivots, which is the
key of an inverted list. A pair is verified by exact cosine in the list of the smallest choice it shares and
nowhere else, so links are counted once. Long lists are parted (``common.cells``); a list sends on one count per vector
and one link per vector it joined, never its pairs. Identical vectors are one entry with a count.

In a dense group the nearest pivots are picked by noise, so those lists alone lose links there. Every pivot also has a ball of
twice the link angle, which is a list too: all links of a vector that is itself within the link angle of a pivot are
in that ball, so such a vector is in the lists of balls alone and loses nothing. A pair that shares a ball is verified
in the first one it shares.

Pivots come from a bounded sample: the first ``SAMPLE`` distinct vectors by a hash. Up to half are those with the most
sampled vectors within the link angle, the others lie farthest apart; no two are within the link angle. Every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cell_pairs, cells, components, grouped, local_roots, map_batches, stored

PIVOTS, NEAREST, SHARED, LEAST_COSINE, CELL = 64, 6, 3, 0.98, 512
SAMPLE, CROWD = 2048, 5  # vectors that pivots are picked from; sampled vectors that make a dense group


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Rows as doubles of length 1, cut or filled with zeros to ``width``."""
    rows = [np.asarray(r, dtype=np.float64) for r in column.to_pylist()]
    width = max((len(r) for r in rows), default=0) if width is None else width
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        r = r[:width]
        out[i, :len(r)] = r
    out /= np.maximum(np.abs(out).max(axis=1, initial=0), 1e-300)[:, None]
    return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-300)[:, None]


def _lowest(bits: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` lowest set bits of each number."""
    out = np.zeros_like(bits)
    for _ in range(n):
        low = bits & (~bits + np.uint64(1))
        out, bits = out | low, bits ^ low
    return out


def pick_pivots(sample: np.ndarray, n: int, least: float) -> np.ndarray:
    """Up to ``n`` rows, none within the link angle of another: middles of dense groups first, then farthest-first."""
    like = sample @ sample.T
    near, open_, picked = like >= least, np.ones(len(sample), dtype=bool), []
    while len(picked) < n // 2:
        count = np.where(open_, near[:, open_].sum(axis=1), 0)
        if count.max() < CROWD:
            break
        picked.append(int(count.argmax()))
        open_ &= ~near[picked[-1]]
    if not picked:
        picked.append(0)
    closest = like[:, picked].max(axis=1)
    while len(picked) < n and closest.min() < least:
        picked.append(int(closest.argmin()))
        closest = np.maximum(closest, like[:, picked[-1]])
    return sample[picked]


def _index(pivots: np.ndarray, nearest: int, shared: int, least: float):
    ball = np.cos(min(np.pi, 2 * np.arccos(least))) - 1e-9

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column("embedding"), pivots.shape[1])
        like = x @ pivots.T
        each = np.uint64(1) << np.arange(len(pivots), dtype=np.uint64)
        inside = like >= ball
        balls = np.bitwise_or.reduce(np.where(inside, each, np.uint64(0)), axis=1)
        # what is cut to the pivots' length may be farther off than it seems
        whole = pc.list_value_length(batch.column("embedding")).to_numpy() <= pivots.shape[1]
        inner = (like.max(axis=1) >= least + 1e-9) & whole
        top = np.sort(np.argsort(-like, axis=1, kind="stable")[:, :nearest], axis=1)
        bit = np.uint64(1) << top.astype(np.uint64)
        mask = np.bitwise_or.reduce(bit, axis=1)
        choices = np.stack([np.bitwise_or.reduce(bit[:, list(c)], axis=1) for c in combinations(range(nearest), shared)], axis=1)

        def lists(values: np.ndarray, count: np.ndarray) -> pa.ListArray:
            at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.uint64).view(np.int64)))

        choices = lists(choices[~inner].ravel(), np.where(inner, 0, choices.shape[1]))
        around = lists(np.broadcast_to(each, inside.shape)[inside], inside.sum(axis=1))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(mask.view(np.int64)), pa.array(balls.view(np.int64)), choices, around],
            [*batch.schema.names, "mask", "balls", "choices", "around"])

    return work


def _verify(shared: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "cell", 8_000):
            node, cell, part, n = (rows.column(c).to_numpy() for c in ("node", "cell", "part", "n"))
            mask, balls, choice = (rows.column(c).to_numpy().view(np.uint64) for c in ("mask", "balls", "choice"))
            around = rows.column("ball").to_numpy()
            x = _matrix(rows.column("embedding"))
            count, near = np.zeros(len(node), dtype=np.int64), []
            for a, b in cell_pairs(cell, part):
                both = balls[a] & balls[b]
                own = np.where(around[a], _lowest(both, 1) == choice[a],
                               (both == 0) & (_lowest(mask[a] & mask[b], shared) == choice[a]))
                a, b = a[own], b[own]
                linked = np.einsum("ij,ij->i", x[a], x[b]) >= least
                if linked.any():
                    a, b = a[linked], b[linked]
                    np.add.at(count, a, n[b])
                    np.add.at(count, b, n[a])
                    near.append((a, b))
            if near:
                a, b = (np.concatenate(v) for v in zip(*near))
                root = local_roots(len(node), a, b)
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(count[some])],
                                                 ["a", "b", "links"])

    return run


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, pivots: int = PIVOTS, nearest: int = NEAREST,
                 shared: int = SHARED, cell: int = CELL) -> DataFrame:
    """vec_id, n_links (other vectors linked directly) and component_id (smallest vec_id reachable) per row.

    ``vectors`` has vec_id, embedding, label; other columns are ignored. Only rows of one label that is not null can
    link, and only vectors of one length. A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing. Rows that repeat a vec_id are vectors of their own. At most 64 pivots.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.col("label").isNotNull() & F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False)) \
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = stored(rows.withColumn("node", F.when(fine, F.xxhash64("label", "embedding"))))
    entries = stored(rows.filter("node is not null").groupBy("node", "label", "embedding")
                     .agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id")))
    sample = entries.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toArrow()
    if sample.num_rows == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    reference = pick_pivots(_matrix(sample.column("embedding")), min(64, pivots), least)
    nearest = min(nearest, len(reference))
    shared = min(shared, nearest)
    schema = "node long, label {}, embedding array<double>, n long, mask long, balls long, choices array<long>, around array<long>".format(
        vectors.schema["label"].dataType.simpleString())
    indexed = map_batches(entries.select("node", "label", "embedding", "n"), _index(reference, nearest, shared, least), schema)
    indexed = stored(indexed)
    told = ("node", "n", "mask", "balls")
    lists = indexed.select(*told, F.size("embedding").alias("dim"), "label", F.explode(F.concat(
        F.transform("choices", lambda c: F.struct(F.lit(False).alias("ball"), c.alias("choice"))),
        F.transform("around", lambda c: F.struct(F.lit(True).alias("ball"), c.alias("choice"))))).alias("list"))
    lists = lists.select(*told, "list.ball", "list.choice", F.xxhash64("label", "dim", "list").alias("key"))
    dealt = cells(lists, "key", "node", cell).select("cell", "part", *told, "ball", "choice") \
        .join(indexed.select("node", "embedding"), "node")
    found = stored(dealt.repartition("cell").sortWithinPartitions("cell")
                   .mapInArrow(_verify(shared, least), "a long, b long, links long"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = stored(components(found.select("a", "b")))
    first = joined.join(entries.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("least"))
    named = joined.join(first, "component").select("node", "least")
    told = stored(entries.join(counts, "node", "left").join(named, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("least", "first_id").alias("component_id")))
    alone = rows.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                               F.col("vec_id").alias("component_id"))
    return rows.filter("node is not null").join(told, "node").select("vec_id", "n_links", "component_id").unionAll(alone)
