"""Documents of like wording: word shingles of Jaccard similarity at least ``LEAST``, found by SimHash fingerprints, each
link verified.

At 0.8 about 15 in 100 fingerprint bits differ, too many for the few blocks of 64 bits. So a fingerprint has ``BITS`` bits, and
its bits are dealt, in several orders, to ``KEYS`` blocks of ``WIDTH`` bits: candidates agree in one whole block, as in op4, and
differ in at most ``RADIUS`` of their first ``HEAD`` bits. Fingerprints that meet in a block are compared in cells of a bounded number
(``common.cells`` beyond ``CROWD``); a cell sends on each fingerprint once, with the group that its near ones make there. Sets whose
sizes alone rule the similarity out are not near.

Documents of one shingle set are one node. A node is first compared with the smallest node of its groups, one pair per node. The same
pairs, linked or not, tell which groups overlap: these become one group where that sends fewer rows and compares no more pairs, so
that nodes which meet in many blocks meet again once. Groups whose nodes are all joined by the first links are done. In the others, nodes
of different components meet in cells of bounded bytes, each with its whole shingle set. There they are verified and joined, and a
cell sends on one link per node it joined, never its pairs. A pair is a link only if its whole shingle sets are similar enough.

The sets are worked out once per node, from one of its texts, and only for nodes that are in a group with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cell_pairs, cells, components, grouped, local_roots, map_batches, stored

SHINGLE, LEAST, SEED, STRIDE = 5, 0.8, 42, 1 << 16
#: Bits of a fingerprint, its blocks and their bits; bits compared where blocks meet, and how many of them may differ.
BITS, KEYS, WIDTH, HEAD, RADIUS = 1024, 128, 14, 128, 40
#: Share of differing bits above which a pair of a cell is not verified: a pair of 0.8 is seven standard deviations below.
APART = 0.25
#: Fingerprints of a block that are compared in one cell; a larger block is dealt to several.
CROWD = 4096
#: Bytes of shingle sets in half a cell; a set larger than that is a cell's half by itself.
CELL = 4 << 20
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, 128, dtype=np.uint64)
_WORDS = BITS // 64
#: The bits of each block: whole permutations of all bits, one after the other, cut into blocks.
_BLOCKS = np.concatenate([_RNG.permutation(BITS) for _ in range(-(-KEYS * WIDTH // BITS))])[:KEYS * WIDTH].reshape(KEYS, WIDTH)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; one of all words if there are fewer; none without words."""
    words = (text or b"").lower().split()  # as in simhash: bytes, A-Z alone is lowered
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size).tolist(), end[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(last)))


def least_hashes(found: np.ndarray, many: int = 125) -> np.ndarray:
    """The least value of the set under each of ``many`` hash functions. The stage does not use it: it is a second signature for tests."""
    out = np.full(many, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), STRIDE):
        part = found[at:at + STRIDE]
        for k in range(len(out)):
            out[k] = min(out[k], (part * _TIMES[k] + _PLUS[k]).min())
    return out


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set, as ``BITS`` bytes of 0 or 1: a bit is 1 if it is set in over half of the shingles' hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(found), 255):  # a byte counts each bit, eight of them are added at once
        words = (found[at:at + 255, None] ^ _PLUS[:_WORDS]) * _TIMES[:_WORDS]
        words ^= words >> np.uint64(32)
        bits = np.unpackbits(words.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        ones += bits.view(np.uint64).sum(axis=0).view(np.uint8)
    return (2 * ones > len(found)).astype(np.uint8)


def block_keys(bits: np.ndarray) -> np.ndarray:
    """For each row of fingerprint bits its blocks, numbered apart."""
    parts = np.packbits(bits[:, _BLOCKS], axis=2, bitorder="little").view("<u2")[..., 0]
    return parts.astype(np.int32) + (np.arange(KEYS, dtype=np.int32) << WIDTH)


def _sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
    nodes, sizes, bits = [], [], np.zeros((batch.num_rows, BITS), dtype=np.uint8)
    for i, text in enumerate(batch.column("text")):
        found = shingle_set(text.as_py())
        nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
        sizes.append(len(found))
        bits[i] = wide_fingerprint(found)
    signs = [x.tobytes() for x in np.packbits(bits, axis=1, bitorder="little")]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("hash"), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
         pa.array(signs, pa.binary())], ["doc_id", "hash", "node", "size", "sign"])


def _blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
    whole = np.frombuffer(b"".join(batch.column("sign").to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
    head = [pa.array(np.ascontiguousarray(whole.view("<i8")[:, k])) for k in range(HEAD // 64)]
    keys = block_keys(np.unpackbits(whole, axis=1, bitorder="little"))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * KEYS), pa.array(keys.ravel()))
    return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), *head, lists], ["node", "size", "w0", "w1", "keys"])


def _near(least: float):
    """Nodes that are near another one of their cell, each once, with the smallest node (key) of the group that near ones make there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "cell", 20_000):
            cell, part, node, size, w0, w1 = (rows.column(c).to_numpy() for c in ("cell", "part", "node", "size", "w0", "w1"))
            near = []
            for a, b in cell_pairs(cell, part):
                apart = np.bitwise_count((w0[a] ^ w0[b]).view(np.uint64)) + np.bitwise_count((w1[a] ^ w1[b]).view(np.uint64))
                ok = apart <= RADIUS
                a, b = a[ok], b[ok]
                ok = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])
                if ok.any():
                    near.append((a[ok], b[ok]))
            if near:
                a, b = (np.concatenate(x) for x in zip(*near))
                root = local_roots(len(node), a, b)
                met = np.unique(np.concatenate((a, b)))
                first = node.copy()
                np.minimum.at(first, root, node)
                yield pa.RecordBatch.from_arrays([pa.array(first[root[met]]), pa.array(node[met]), pa.array(size[met])], ["key", "node", "size"])

    return run


def near_groups(nodes: DataFrame, least: float = LEAST, crowd: int = CROWD) -> DataFrame:
    """Groups of nodes with fingerprints near each other: key, node, size. Groups with the same smallest node, the key, are one."""
    blocks = stored(map_batches(nodes.filter("size > 0").select("node", "size", "sign"), _blocks,
                                "node long, size long, w0 long, w1 long, keys array<int>"))
    keyed = blocks.select("node", "size", "w0", "w1", F.explode("keys").alias("key"))
    full = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("key"))
    plain, dealt = keyed, None
    if not full.isEmpty():
        plain = keyed.join(full, "key", "left_anti")
        dealt = cells(keyed.join(full, "key", "left_semi"), "key", "node", crowd).select("cell", "part", "node", "size", "w0", "w1")
    plain = plain.select(F.col("key").cast("long").alias("cell"), F.lit(-1).alias("part"), "node", "size", "w0", "w1")
    rows = plain if dealt is None else plain.unionAll(dealt)
    met = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_near(least), "key long, node long, size long")
    return stored(met.distinct())


def merged_groups(groups: DataFrame, pairs: DataFrame, cell: int = CELL) -> DataFrame:
    """Groups (key, node, size) in which all nodes meet that meet in ``groups``. Groups whose keys the pairs (a, b) connect
    become one where that makes no more rows in cells of ``cell`` bytes and no more pairs than they do apart."""
    joined = components(pairs).select(F.col("node").alias("key"), F.col("component").alias("nest"))
    told = stored(groups.join(joined, "key", "left").select("key", F.coalesce("nest", "key").alias("nest"), "node", "size"))
    n = F.count(F.lit(1))
    apart = told.groupBy("nest", "key").agg(n.alias("n")).groupBy("nest").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    whole = told.select("nest", "node", "size").distinct().groupBy("nest").agg(n.alias("n"), F.sum(_bytes()).alias("bytes"))
    fewer = (F.ceil(F.col("bytes") / cell) * F.col("n") <= F.col("rows")) & (F.col("n") * (F.col("n") - 1) <= F.col("pairs"))
    better = stored(apart.join(whole, "nest").filter(fewer).select("nest", F.col("nest").alias("one")))
    return stored(told.join(better, "nest", "left").select(F.coalesce("one", "key").alias("key"), "node", "size").distinct())


def _bytes() -> Column:
    return F.col("size") * 8 + 256


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [shingle_set(t).tobytes() for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("sign"), pa.array(found, pa.binary())], ["node", "sign", "found"])


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def _similar(least: float):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [_alike(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in pair), least)
                for pair in zip(batch.column("x"), batch.column("y"))]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work


def _joined(least: float):
    """Links (a, b) that connect the nodes of each cell as all its verified pairs of different components do: one
    for every node that is joined to another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "cell", 1):
            node, cell, part, size, component = (rows.column(c).to_numpy() for c in ("node", "cell", "part", "size", "component"))
            sign = np.frombuffer(b"".join(rows.column("sign").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
            far = APART * 8 * sign.shape[1]
            found = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in rows.column("found")]
            root = np.arange(len(node))
            for a, b in cell_pairs(cell, part):
                ok = (component[a] != component[b]) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]))
                a, b = a[ok], b[ok]
                ok = (root[a] != root[b]) & (np.bitwise_count(sign[a] ^ sign[b]).sum(axis=1, dtype=np.int64) <= far)
                links = [(i, j) for i, j in zip(a[ok].tolist(), b[ok].tolist()) if _alike(found[i], found[j], least)]
                if links:
                    i, j = (np.array(x) for x in zip(*links))
                    root = local_roots(len(node), np.concatenate((i, np.arange(len(node)))), np.concatenate((j, root)))
            moved = np.flatnonzero(root != np.arange(len(node)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["a", "b"])

    return run


def near_copies(docs: DataFrame, least: float = LEAST, cell: int = CELL, crowd: int = CROWD) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable by links) for every row of ``docs``.

    Null, empty and white texts are one set without shingles. Rows that repeat a doc_id stay apart as rows. A null
    doc_id is smallest only where its whole component has no other. Other columns are ignored.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(map_batches(texts, _sketch, f"doc_id {kind}, hash long, node long, size long, sign binary"))
    kept = [F.first(c).alias(c) for c in ("size", "sign")]
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("hash", "doc_id")).alias("text"), *kept))
    keyed = near_groups(nodes, least, crowd)
    pairs = stored(keyed.groupBy("node").agg(F.min("key").alias("b")).filter("node <> b").withColumnRenamed("node", "a"))

    # one text of each node, named by its hash and doc_id; rows alike in both are the same text
    of_node = nodes.join(keyed.select("node").distinct(), "node", "left_semi") \
        .select("node", "sign", F.col("text.hash").alias("hash"), F.col("text.doc_id").alias("_id"))
    held = texts.join(of_node, "hash").filter(F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "sign", "text")
    sets = stored(map_batches(held, _sets, "node long, sign binary, found binary").dropDuplicates(["node"]))
    whole = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a") \
        .join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    links = stored(map_batches(whole.select("a", "b", "x", "y"), _similar(least), "a long, b long"))
    joined = stored(components(links))
    told = merged_groups(keyed, pairs, cell).join(joined, "node", "left")
    told = stored(told.select("key", "node", "size", F.coalesce("component", "node").alias("component")))
    mixed = told.groupBy("key").agg((F.min("component") != F.max("component")).alias("mixed")).filter("mixed").select("key")
    mixed = stored(told.join(mixed, "key", "left_semi"))
    dealt = cells(mixed, "key", "node", cell, _bytes()).join(sets, "node")
    more = dealt.select("cell", "part", "node", "size", "component", "sign", "found").repartition("cell") \
        .sortWithinPartitions("cell").mapInArrow(_joined(least), "a long, b long")
    joined = stored(components(links.unionAll(stored(more))))
    member = joined.join(nodes.select("node", "first_id"), "node")
    first = member.groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = joined.join(first, "component").select("node", "least_id")
    named = stored(nodes.select("node", "first_id").join(named, "node", "left")
                   .select("node", F.coalesce("least_id", "first_id").alias("component_id")))
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
