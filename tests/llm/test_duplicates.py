"""SimHash, substrings, vectors and line runs against brute force."""

import collections
import random

import numpy as np
import pytest
import xxhash

from tickloom.llm import common, simhash
from tickloom.llm.line_dedup import dedup_lines
from tickloom.llm.pivots import near_vectors
from tickloom.llm.substrings import remove_repeats, rounds
from plain_versions import brute_lines, components_of


def brute_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, odd, none):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[random.choice(vocabulary) for _ in range(random.choice([3, 40, 120]))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for _ in range(90):
        b = list(random.choice(base))
        for _ in range(random.randint(0, 2)):
            b[random.randrange(len(b))] = random.choice(vocabulary)
        texts.append("  ".join(b).upper() if random.random() < .3 else "\n".join(b))
    rows = [(i + 100, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (3, " \t")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == prints
    want = components_of(prints, lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(simhash.near_duplicates(odd).collect()) == odd.count() and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("cell,dense", [(512, 20_000), (4, 20_000), (4, 6)])
def test_links_of_a_dense_ball(spark, cell, dense):
    """Many fingerprints around one: parted cells and middle values connect what all pairs would."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(60)}
    prints |= {rng.getrandbits(64) for _ in range(40)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    frame = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    edges = common.stored(simhash.links(frame, cell, dense))
    got = {r.node: r.component for r in common.components(edges).collect()}
    want = components_of({v: p for p, v in signed.items()}, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4)
    assert {v: got.get(v, v) for v in signed.values()} == want


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 2000), (5000, 1000)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 2000: 1000, 5000: 1000}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, n):
    seen = collections.Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - n + 1):
            if seen[t[i:i + n]] > 1:
                gone[i:i + n] = True
        gone = gone[:len(t)]
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, dtype=np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("window,gram,crowd", [(40, 8, 512), (40, 8, 3), (24, 6, 2)])
def test_substrings(spark, odd, none, window, gram, crowd):
    rng = random.Random(5)

    def some(n):
        return "".join(rng.choice("abcde fghé\n") for _ in range(n))

    base = [some(rng.randint(0, 300)) for _ in range(40)]
    texts = list(base)
    for _ in range(80):
        a = rng.choice(base)
        i = rng.randint(0, len(a))
        texts.append(some(rng.randint(0, 50)) + a[i:rng.randint(i, len(a))] + some(rng.randint(0, 50)))
    texts += ["xyz " * 50, "xyz " * 37 + "q", "aaaa" * 40, "", base[3], base[3]]
    texts += [some(20) + base[5][:90] + some(20) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, sum(s["past"] - s["first"] for s in r.removed), len(r.removed), bytes(r.kept))
           for r in remove_repeats(frame, window, gram, crowd).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], window)
    if crowd == 512:
        rows = remove_repeats(odd, 5, 2).collect()
        assert len(rows) == odd.count() and remove_repeats(none, 5, 2).count() == 0
        assert {bytes(r.kept) for r in rows if r.doc_id == 4} == {b""} and {r.n_bytes for r in rows if r.doc_id == 1} == {0}


@pytest.mark.parametrize("crowd", [512, 1])
def test_shared_anchors_without_a_repeat(spark, crowd):
    """Ranges meet, but what they share is shorter than the window: nothing goes."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(60)) + "0123456789ABCDEFGHIJ" + "".join(rng.choice("abcdefgh") for _ in range(60))
             for _ in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(len(r.removed), len(r.kept)) for r in remove_repeats(frame, 40, 8, crowd).collect()] == [(0, 140)] * 12


def test_rounds_sort_suffixes():
    docs = [b"banana", b"anan", b"ban", b"zz"]
    width = max(map(len, docs))
    symbols = np.zeros((width, len(docs)), dtype=np.uint16)
    for j, d in enumerate(docs):
        symbols[:len(d), j] = np.frombuffer(d, dtype=np.uint8) + 1
    for c, order, common_, put in rounds(symbols, np.zeros(len(docs), dtype=np.int64)):
        tails = [docs[j][c:] for j in order]
        assert tails == sorted(tails) and list(put) == [t[0] + 1 if t else 0 for t in tails]
        for i in range(1, len(tails)):
            same = next((k for k, (x, y) in enumerate(zip(tails[i - 1], tails[i])) if x != y), min(map(len, tails[i - 1:i + 1])))
            assert common_[i] == same


@pytest.mark.parametrize("cell", [512, 5])
def test_vectors(spark, cell):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows, n = [], 0
    for k in range(140):
        v = centres[k % 12] + rng.normal(size=16) * rng.choice([0.01, 0.05, 0.12])
        rows.append((n, [float(x) for x in v], int(k % 3 == 0)))
        n += 1
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(6)]
    n += 6
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [None] * 16, 1),
             (n + 5, rows[0][1], None), (n + 6, rows[0][1][:8], 1), (n + 7, [float("inf")] + [1.0] * 15, 1), (n + 8, [2 * x for x in rows[1][1]], rows[1][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame, cell=cell).collect()}
    good = {i: (np.array(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}

    def linked(a, b):
        (x, la), (y, lb) = good[a], good[b]
        return la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    want = components_of(good, linked)
    links = {a: sum(a != b and linked(a, b) for b in good) for a in good}
    assert got == {i: (links.get(i, 0), want.get(i, i)) for i, *_ in rows}
    assert near_vectors(frame.limit(0)).count() == 0
    assert {tuple(r) for r in near_vectors(frame.filter("label is null")).collect()} == {(n + 5, 0, n + 5)}


@pytest.mark.parametrize("noise", [0.009, 0.0125])
def test_vectors_of_a_dense_group(spark, noise):
    """A third of the rows are distinct near copies of one vector: no link of theirs is lost."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:300] = x[0] + rng.normal(size=(300, 64)) * noise
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in near_vectors(frame).collect()}
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert want[:300].mean() > 250 and got == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_lines(spark, n):
    rng = random.Random(n)
    texts = ["\n".join(rng.choice(["a", "b", "c c", "", " ", "d"]) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts += ["x\nx\nx\nx\nx\nx", texts[5], ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(frame, n).collect()}
    assert got == brute_lines(texts, n)


def test_lines_odd_rows(spark, odd, none):
    got = dedup_lines(odd.withColumn("n_lines", odd.doc_id)).collect()
    assert len(got) == odd.count() and got[0].asDict().keys() >= set(odd.columns)
    assert [r.text for r in got if r.doc_id == 6] == ["ab"] and [r.text for r in got if r.doc_id == 1] == [None]
    assert {r.text for r in got if r.doc_id in (4, 5)} == {"one two three four five"}
    assert dedup_lines(none).count() == 0


def test_line_names_that_collide_in_one_half_stay_apart(spark, monkeypatch):
    """A name is two hashes: lines that agree in one of them only are different lines."""
    from pyspark.sql import functions as F

    from tickloom.llm import line_dedup

    rows = [(1, "a\nb\nc"), (2, "x\ny\nz"), (3, "a\nb\nq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, dedup_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "_line_name", lambda x: F.struct(F.lit(7).cast("long").alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    assert sorted(map(str, dedup_lines(docs).collect())) == want
    monkeypatch.setattr(line_dedup, "_line_name", lambda x: F.struct(F.xxhash64(x).alias("a"), F.lit(7).cast("long").alias("b")))
    assert sorted(map(str, dedup_lines(docs).collect())) == want


# -- the registered queries, at their own parameters, over whole tables --------------------------


def test_op4_query_equals_brute_force(spark, sf_dir):
    from tickloom.llm.queries import op4_simhash

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    prints = {i: brute_print(t) for i, t in docs}
    first = {}
    for i in sorted(prints):
        first.setdefault(prints[i], i)
    root = components_of(first.values(), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in op4_simhash(spark, sf_dir).collect()}
    assert got == {(i, f"{p:016x}", root[first[p]]) for i, p in prints.items()}


def test_op6_query_equals_brute_force(spark, sf_dir):
    import hashlib

    from tickloom.llm.queries import op6_substrings

    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    seen = collections.Counter()
    for _, t in docs:
        seen.update(xxhash.xxh3_128_intdigest(t[i:i + 400]) for i in range(len(t) - 399))
    want = set()
    for doc_id, t in docs:
        gone = np.zeros(len(t) + 1, dtype=np.int64)
        for i in range(len(t) - 399):
            if seen[xxhash.xxh3_128_intdigest(t[i:i + 400])] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        lost = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], lost.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~lost]) if t else b""
        want.add((doc_id, len(t), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest(), spans > 0))
    assert {tuple(r) for r in op6_substrings(spark, sf_dir).collect()} == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)


def test_op7_query_equals_brute_force(spark, sf_dir):
    from tickloom.llm.queries import op7_pivots

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    column = next(c for c in table.columns if c not in ("vec_id", "label"))
    alive = [(int(i), lab, np.array(v, dtype=np.float64)) for i, lab, v in zip(table.vec_id, table.label, table[column])]
    unit = {i: v / np.linalg.norm(v) for i, lab, v in alive if np.isfinite(v).all() and np.linalg.norm(v) > 0}
    label = {i: lab for i, lab, _ in alive}
    ids = sorted(unit)
    near = np.stack([unit[i] for i in ids]) @ np.stack([unit[i] for i in ids]).T >= 0.98
    linked = {(a, b) for x, a in enumerate(ids) for y, b in zip(np.flatnonzero(near[x]), np.array(ids)[near[x]])
              if a != b and label[a] == label[b] and label[a] is not None}
    root = components_of([i for i, _, _ in alive], lambda a, b: (a, b) in linked) if linked else {i: i for i, _, _ in alive}
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in op7_pivots(spark, sf_dir).collect()}
    assert got == {(i, sum(1 for a, _ in linked if a == i), root[i], root[i] == i) for i, _, _ in alive}
