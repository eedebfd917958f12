"""Ranked search, license scans and phrases against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from tickloom.llm import lexical, phrases
from tickloom.llm.common import portions
from tickloom.llm.lexical import rank_documents, term_counts
from tickloom.llm.licenses import NOTICES, PHRASES, license_spans
from tickloom.llm.oracles import ORACLES
from tickloom.llm.phrases import collocations, steps, transform
from tickloom.llm.queries import llm_queries

LOWER = {i: i + 32 for i in range(65, 91)}
DOC = "doc_id long, text string, lang string"


@pytest.mark.parametrize("name", ["op11_dual_tree", "op12_licenses", "op13_phrases"])
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(llm_queries()[name](spark, sf_dir), duck(sf_dir), ORACLES[name]) is None


def test_portions_cut_no_word():
    text = b"".join(random.Random(1).choice([b"ab", b" ", b".", b"\n", b"cde"]) for _ in range(500))
    for size in (1, 7, 100, 10_000):
        parts = list(portions(text, re.compile(rb"[ .\n]"), size))
        assert b"".join(parts) == text
        assert [w for p in parts for w in re.findall(rb"[a-e]+", p)] == re.findall(rb"[a-e]+", text)


# ---- ranked search

def _brute_ranks(docs, items, top=10):
    docs = [(i, c, c.total()) for i, t in docs if (c := term_counts(t.encode() if t else None))]
    n, total = len(docs), sum(k for _, _, k in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for number, (item, text) in enumerate(items):
        terms = [t for t in set(term_counts(text.encode() if text else None)) if t in df]
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for i, c, k in docs:
            m = 10 + 90 * k * n // total
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, number, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def _ranks(found):
    return sorted(((r["item_id"], r["item"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str)


def _wordy(rng, n, most):
    pool = [f"w{int(rng.expovariate(0.03))}" for _ in range(400)] + ["É", "日本", "A9"]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_ranks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = _wordy(rng, 600, 60)
    texts += [texts[3]] * 300 + [None, "", "... !!", texts[4] * 40]  # a third are copies: ties by doc_id
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (7, texts[5]), (7, texts[5])]
    items = [(i // 2, t) for i, t in enumerate(_wordy(rng, 90, 25) + [None, "", "nowhere"])]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string")
    want = _brute_ranks(docs, items)
    assert _ranks(rank_documents(*frames)) == want
    monkeypatch.setattr(lexical, "ITEMS", 30)  # several blocks
    monkeypatch.setattr(lexical, "CELLS", 1)   # chunks of one leaf
    assert _ranks(rank_documents(*frames)) == want


def test_walk_prunes_whole_batches(monkeypatch):
    """Documents of other words than an item's are never scored."""
    rows = [(k, {b"a%d" % (k % 4), b"b%d" % (k % 4), b"c%d" % k}) for k in range(64)]
    block = lexical.Items(rows)
    assert sorted(block.numbers) == list(range(64)) and len(block.levels[0][0]) == 65
    import pyarrow as pa
    texts = [b"a%d b%d c%d" % (k // 64, k // 64, k % 64) for k in range(256)]
    batch = block.count(pa.RecordBatch.from_pydict({"doc_id": pa.array(range(256), pa.int64()), "text": pa.array(texts, pa.binary())}))
    search = lexical.Search(block, np.full(len(block.vocabulary), 1000), 256, 768, 1)
    seen, real = [], lexical.Best.add
    monkeypatch.setattr(lexical.Best, "add", lambda self, *x: (seen.append(len(x[0])), real(self, *x)))
    best = lexical.Best(64, 1)
    search.chunk = 64
    for at in range(0, 256, 64):
        search.walk(pa.Table.from_batches([batch.slice(at, 64)]), best)
    assert sum(seen) < 64 * 256 / 3


def test_search_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one two"), (None, "b c"), (2, None)], "item_id long, text string").withColumn("n", F.lit(1))
    want = _brute_ranks([(r.doc_id, r.text) for r in odd.collect()], [(1, "one two"), (None, "b c"), (2, None)])
    assert _ranks(rank_documents(odd, items)) == want
    assert rank_documents(none, items).count() == 0 and rank_documents(odd, items.limit(0)).count() == 0


# ---- licenses

def _places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), sorted((i, label) for label, phrase in PHRASES for i in range(len(words))
                              if words[i:i + len(phrase.split())] == phrase.split())


def test_license_phrases_equal_brute_force(spark):
    rng = random.Random(3)
    bits = [w for _, p in PHRASES for w in p.split()] + ["the", "x", "Under", "MIT,", "é", "CC-BY-NC", "\n"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "under the mit license", "cc by nc " * 50, "a " * 200_000 + "cc by nc"]
    rows = list(enumerate(texts)) + [(None, "cc by nc"), (5, texts[5]), (5, texts[5])]
    got = license_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    found = Counter((r["doc_id"], r["n_words"], tuple((s["first"], s["label"]) for s in r["spans"] if s["base"])) for r in got)
    assert found == Counter((i, n, tuple(p)) for i, (n, p) in ((i, _places(t)) for i, t in rows))


def test_notices_with_changes(spark):
    mit = dict((label, text) for label, text in NOTICES if label == "mit")["mit"].split()
    changed = mit[:8] + ["to"] + mit[8:14] + mit[15:]            # a word more, a word less: three diagonals
    half, stretched = mit[:12], [x for w in mit for x in (w, "x")]
    rows = [(1, " ".join(mit)), (2, "A b. " + " ".join(changed).upper()), (3, " ".join(half)), (4, " ".join(stretched))]
    got = {r["doc_id"]: r["spans"] for r in license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.first, s.past, s.label, s.base, s.share) for s in got[1]] == [(0, len(mit), "mit", False, 1.0)]
    assert [(s.first, s.past, s.label) for s in got[2]] == [(2, 2 + len(changed), "mit")] and 0.7 < got[2][0].share < 1
    assert got[3] == got[4] == []


def test_license_odd_rows(spark, odd, none):
    got = license_spans(odd).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((r.doc_id, _places(r.text)[0]) for r in odd.collect())
    assert license_spans(none).collect() == []
    with pytest.raises(ValueError):
        license_spans(odd, phrases=(("x", "two words"),))


def test_license_scan_runs_without_python(spark, odd):
    plan = license_spans(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


# ---- phrases

def _brute_phrases(rows, least, first):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        held = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                held.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, held in counts.items():
        candidates = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        inside = {p[i:i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                  if 100 * a >= 100 * held[p[i:i + k]]}
        best = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * total[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:first])]
    return sorted(out)


def _phrases(found):
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shard", [50, 1 << 21])
def test_phrases_equal_brute_force(spark, shard, monkeypatch):
    rng = random.Random(9)
    bits = ["a", "b", "B", "c", "d", "é", "x\xa0y", "\x1c", "a b c d e f", "a b", ".", ",", "\n", "\t", "!", "z z z"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for _ in range(400)]
    rows += [("en", None), ("en", ""), ("fr", " \t. "), ("en", "a b c d e f " * 300), ("long", "one two three. " * 5000)]
    rows += [("en", rows[0][1])] * 200
    docs = spark.createDataFrame([(None, t, lang) for lang, t in rows], DOC).repartition(4)
    want = _brute_phrases(rows, 12, 70)
    assert _phrases(collocations(docs, least=12, first=70, shard=shard)) == want
    if shard == 50:
        monkeypatch.setattr(phrases, "LOOKUP_BYTES", 0)  # pairs by a join
        assert _phrases(collocations(docs, least=12, first=70, shard=shard)) == want


def test_longer_phrases_grow_from_frequent_ones(spark, monkeypatch):
    rng = random.Random(4)
    words = [rng.choice("abcdefghij") for _ in range(20_000)] + ["k", "l", "m", "n", "o", "p"] * 100
    text, least, made = " ".join(words), 100, []
    extended = phrases._extended

    def counted(*args):
        made.append(extended(*args).count())
        return extended(*args)

    monkeypatch.setattr(phrases, "_extended", counted)
    found = _phrases(collocations(spark.createDataFrame([(1, text, "en")], DOC), least=least))
    assert found == _brute_phrases([("en", text)], least, phrases.FIRST)
    held = [Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) for k in range(6)]
    grown = [sum(held[k - 1][p[1:]] >= least and held[k - 1][p[:-1]] >= least for p in held[k]) for k in (2, 3, 4, 5)]
    assert made[0] == grown[0] and sum(made[1:]) == sum(grown[1:])


def test_shards_are_shuffled_once_a_pass(spark):
    ids = [np.array(x, dtype=np.int32) for x in ([1, 2, 1, 2, 0], [1, 1, 0])]
    rows = [(i, -1, len(x), bytearray(phrases._packed(transform(x)))) for i, x in enumerate(ids)]
    shards = spark.createDataFrame(rows, "shard long, lo int, n int, bwt binary")
    words = spark.createDataFrame([(0, 1, 2, 11), (0, 3, 2, 12)], "shard long, lo int, n int, id long")  # none of shard 1
    found = phrases._extended(shards, words, phrases._longer())
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 2, 11, 12), (0, 4, 1, 12, 11)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_transform_walks_back():
    ids = np.array([random.Random(2).randint(0, 5) for _ in range(3000)] + [0] * 6, dtype=np.int32)
    first, right = steps(transform(ids))
    rows = [first]
    for _ in range(4):
        rows.append(first[right] if len(rows) == 1 else first[place])
        place = right[right] if len(rows) == 2 else right[place]
    got = Counter(zip(*(r.tolist() for r in rows)))
    twice = ids.tolist() * 2
    assert got == Counter(tuple(twice[i:i + 5]) for i in range(len(ids)))
    assert list(zip(*(r.tolist() for r in rows))) == sorted(zip(*(r.tolist() for r in rows)))


def test_products_beyond_64_bits(spark):
    rows = [("en", "a b " * 10)]
    found, totals = phrases.frequent_phrases(spark.createDataFrame([(1, t, x) for x, t in rows], DOC), 2)
    assert totals.first()["n"] == 20
    big = spark.range(1).select(F.lit(10**12).cast("long").alias("f"), F.lit(9 * 10**12).alias("n"))
    wide = (F.col("f").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    assert int(big.select(wide.cast("decimal(38,0)").alias("x")).first()["x"]) == 9 * 10**27


def test_phrases_odd_rows(spark, odd, none):
    want = _brute_phrases([(r.lang, r.text) for r in odd.collect()], 2, 10)
    assert _phrases(collocations(odd, least=2, first=10)) == want and want
    assert collocations(none).count() == 0


def test_frequent_words_reach_their_shards_without_a_join(spark, monkeypatch):
    """Each word's intervals in all shards carry its one number and sum; no join of words with their frequent ones makes them."""
    plans, keep = [], phrases.stored

    def seen(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return keep(rows)

    monkeypatch.setattr(phrases, "stored", seen)
    rows = [("en", "a b c. rare"), ("de", "a b"), (None, "c a b")] * 40 + [("en", "only once")]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], DOC)
    found, _ = phrases.frequent_phrases(docs, 40, 20)
    got = {(r.lang, r.phrase): r.f for r in found.filter("size = 1").collect()}
    assert got == {("en", x): 40 for x in ("a", "b", "c", "rare")} | {("de", x): 40 for x in "ab"} | {("und", x): 40 for x in "abc"}
    assert plans and not any(re.search(r"Join Inner.*word#", p) for p in plans)
