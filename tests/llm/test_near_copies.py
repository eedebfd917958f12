"""Near copies by shingle similarity against brute force, in the function and in the pipeline's stage."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tickloom.llm.near_copies import _joined, least_hashes, near_copies
from plain_versions import components_of


def brute_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def edited_texts():
    """Chains of edits, so that many pairs lie on either side of the threshold and some join only over a third."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 60, 150, 400]))]
        for _ in range(9):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 50))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("cell", [512, 3])
def test_near_copies(spark, odd, none, cell):
    rows = [(i + 100, t) for i, t in enumerate(edited_texts())] + [(1, None), (2, ""), (3, " \t")]
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell).collect()}
    sets = {i: brute_set(t) for i, t in rows}
    assert got == components_of(sets, lambda a, b: similar(sets[a], sets[b]))
    assert len(near_copies(odd).collect()) == odd.count() and near_copies(none).count() == 0


@pytest.mark.parametrize("edits, linked", [(4, True), (8, False)])
def test_a_cell_sends_no_more_than_it_got(edits, linked):
    """Groups of documents alike, linked and not: what a cell sends on does not grow with its pairs."""
    rng = np.random.default_rng(1)
    for n in (100, 200, 400):
        base = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
        sets = []
        for _ in range(n):
            own = base.copy()
            own[rng.choice(100, edits, replace=False)] = rng.integers(0, 1 << 60, edits, dtype=np.uint64)
            sets.append(np.unique(own))
        batch = pa.RecordBatch.from_pydict({
            "cell": pa.array([1] * n), "part": pa.array([-1] * n), "node": pa.array(range(n)), "size": pa.array([len(s) for s in sets]),
            "component": pa.array(range(n)), "sign": pa.array([least_hashes(s).astype("<u2").tobytes() for s in sets], pa.binary()),
            "found": pa.array([s.tobytes() for s in sets], pa.binary())})
        sent = sum(out.num_rows for out in _joined(0.8)(iter([batch])))
        assert sent == n - len(set(components_of(range(n), lambda a, b: similar(set(sets[a]), set(sets[b]))).values()))
        assert (sent > n / 2) == linked and sent < n


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    rows = list(enumerate(edited_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    sets = {i: brute_set(t) for i, t in rows}
    assert kept == set(components_of(sets, lambda a, b: similar(sets[a], sets[b])).values())


def test_fingerprint_is_a_simhash():
    """Each bit by majority over the shingles' hashes; like sets differ in few bits, share a block and are near in the head."""
    from tickloom.llm import near_copies as nc

    rng = np.random.default_rng(2)
    shingles = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    each = np.array([nc.wide_fingerprint(shingles[i:i + 1]) for i in range(len(shingles))])
    assert nc.wide_fingerprint(shingles).tolist() == (2 * each.sum(axis=0) > len(shingles)).astype(int).tolist()
    for shared, own in ((8, 1), (80, 10), (240, 30)):  # similarity 0.8
        sets = rng.integers(0, 1 << 63, (500, shared + 2 * own), dtype=np.uint64)
        x = np.array([nc.wide_fingerprint(s[:shared + own]) for s in sets])
        y = np.array([nc.wide_fingerprint(np.delete(s, slice(0, own))[:shared + own]) for s in sets])
        assert (nc.block_keys(x) == nc.block_keys(y)).any(axis=1).all()
        assert (x != y)[:, :nc.HEAD].sum(axis=1).max() <= nc.RADIUS and (x != y).mean(axis=1).max() < nc.APART


def test_crowded_blocks_give_the_same_copies(spark):
    rows = list(enumerate(edited_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: brute_set(t) for i, t in rows}
    got = {r.doc_id: r.component_id for r in near_copies(docs, crowd=2).collect()}
    assert got == components_of(sets, lambda a, b: similar(sets[a], sets[b]))


def test_nodes_that_meet_in_many_blocks_meet_again_once(spark):
    """A group of near copies goes to the cells about once per node, with every two nodes that met before, and links as brute force does."""
    from pyspark.sql import functions as F

    from tickloom.llm import near_copies as nc

    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(w if rng.random() > 0.025 else f"x{rng.random()}" for w in base) for _ in range(80)]
    texts += [" ".join(f"y{rng.random()}" for _ in range(300)) for _ in range(20)]
    signs = [(i, len(s), np.packbits(nc.wide_fingerprint(s), bitorder="little").tobytes())
             for i, s in enumerate(nc.shingle_set(t.encode()) for t in texts)]
    groups = nc.near_groups(spark.createDataFrame(signs, "node long, size long, sign binary")).cache()
    pairs = groups.groupBy("node").agg(F.min("key").alias("b")).filter("node <> b").withColumnRenamed("node", "a")
    met, again = {}, {}
    for held, rows in ((met, groups.collect()), (again, nc.merged_groups(groups, pairs).collect())):
        for r in rows:
            held.setdefault(r.key, set()).add(r.node)
    assert sum(map(len, met.values())) > 10 * 80 and sum(map(len, again.values())) <= 2 * 80
    assert all(any(g <= h for h in again.values()) for g in met.values())
    sets = {i: brute_set(t) for i, t in enumerate(texts)}
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == components_of(sets, lambda a, b: similar(sets[a], sets[b]))
