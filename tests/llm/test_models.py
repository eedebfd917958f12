"""Toxicity and quality: held-out results, swaps, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import quality, toxicity
from tickloom.llm.queries import op1_toxicity, op3_quality

LABELS = "doc_id long, quality int, toxic int"


def test_swaps_keep_the_score_steady():
    rng = np.random.default_rng(1)
    plain = [" ".join(rng.choice(["tree", "river", "stone", "cloud", "road"], 8)) for _ in range(300)]
    # the group is named in most toxic texts, as in a biased sample
    toxic = [f"{p} women are vile." if i % 5 else f"{p} vile." for i, p in enumerate(plain[:100])]
    labels = [0] * 200 + [1] * 100
    texts = plain[100:] + toxic
    steady, _ = toxicity.fit(texts, labels)
    assert toxicity.counterfactuals("Women are here.") and not toxicity.counterfactuals("Nobody is here.")
    loose = dict(steady)
    weight, toxicity.SWAP_WEIGHT = toxicity.SWAP_WEIGHT, 0.0
    try:
        loose, _ = toxicity.fit(texts, labels)
    finally:
        toxicity.SWAP_WEIGHT = weight

    def word(weights, w):
        return sum(weights.get(f, 0.0) for f in toxicity.word_features(w))

    assert abs(word(steady, "women") - word(steady, "men")) < 0.5 * abs(word(loose, "women") - word(loose, "men"))
    assert word(steady, "vile") > 1


def test_the_cap_keeps_the_balance(spark):
    """Words that tell nothing score the counted share of toxic labels, whether or not the cap evens the sample out."""
    rng = np.random.default_rng(2)
    words = ["tree", "river", "stone", "cloud", "road", "hill", "lake", "wind"]
    texts = [" ".join(rng.choice(words, 4)) + (" vile" if i % 8 == 0 and i % 3 else "") for i in range(640)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(640)], LABELS)
    whole, capped = ({r.doc_id: r.toxic_score for r in toxicity.toxicity(docs, labels, F.lit(True), n).collect()} for n in (2500, 80))

    def logit(p):
        return np.log(p / (1 - p))

    shift = np.median([logit(capped[i]) - logit(whole[i]) for i in capped])
    assert abs(shift) < 0.7, shift


@pytest.mark.parametrize("query,column,threshold", [(op1_toxicity, "toxic", 0.5), (op3_quality, "quality", 0.7)])
def test_held_out(spark, query, column, threshold):
    sf_dir = "/root/testdata/sf0.1"
    scored = query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(scored) > 100 and scored.score.between(0, 1).all() and ((scored.score >= threshold) == (scored.predicted == 1)).all()
    assert (scored.predicted == scored[column]).mean() > 0.97


@pytest.mark.parametrize("apply,column", [(toxicity.toxicity, "toxic_score"), (quality.quality, "quality_score")])
def test_odd_rows(spark, odd, none, apply, column):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (5, 1, 0), (5, 1, 0)], LABELS)
    got = apply(odd.withColumn(column, F.lit("old")), labels, F.lit(True))
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r[column] <= 1 for r in rows)
    same = {r[column] for r in rows if r.text == "one two three four five"}
    assert len(same) == 1
    assert apply(none, labels, F.lit(True)).count() == 0
    nothing = apply(odd, labels.limit(0), F.lit(True)).select(column).distinct().collect()
    assert len(nothing) == 1
    assert apply(odd, labels, F.col("quality") > 5).select(column).distinct().count() == 1


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    chain = quality.Chain()
    chain.w, chain.bias, chain.tie = rng.normal(size=quality.WEIGHTS), 0.2, rng.normal(size=(2, 2))
    texts = [b"a b\nc!\n\nD 1 2", b"x", b"", b"q q q\nw"]
    bins, _, count = quality.line_features(texts)
    feats = quality._neighbours(bins, count)
    got, _ = chain.marginals(feats, count)
    at = 0
    for n in count:
        score = chain.w[feats[at:at + n]].sum(axis=1) + chain.bias
        total, good = 0.0, np.zeros(n)
        for labels in product((0, 1), repeat=int(n)):
            p = np.exp(sum(s for s, y in zip(score, labels) if y) + sum(chain.tie[a, b] for a, b in zip(labels, labels[1:])))
            total += p
            good += p * np.array(labels)
        assert np.allclose(got[at:at + n], good / total)
        at += n


def _flagged(weights, bias, sentences):
    return sum(bias + sum(weights.get(f, 0.0) for w in set(toxicity.WORD.findall(s.lower())) for f in toxicity.word_features(w)) > 0
               for s in sentences)


@pytest.mark.parametrize("named", [True, False])
def test_neutral_mentions_are_flagged_less_with_the_penalty(named):
    """Whether the labelled sentences name a group or only hold words that begin like a name."""
    rng = np.random.default_rng(3)
    plain = [" ".join(rng.choice(["tree", "river", "stone", "cloud", "road"], 6)) for _ in range(400)]
    bad = "women" if named else "womexx"
    texts = plain[100:] + [f"{p} {bad} vile." if i % 4 else f"{p} {bad}." for i, p in enumerate(plain[:100])]
    labels = [0] * 300 + [1] * 100
    neutral = [f"{p} women." for p in plain[100:200]]
    terms = (("women", "men"),)
    with_it = toxicity.fit(texts, labels, 0.5, terms)
    weight, toxicity.SWAP_WEIGHT = toxicity.SWAP_WEIGHT, 0.0
    try:
        without = toxicity.fit(texts, labels, 0.5, terms)
    finally:
        toxicity.SWAP_WEIGHT = weight
    assert _flagged(*with_it, neutral) < _flagged(*without, neutral)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_repeated_and_long_documents_give_at_most_one_training_row(spark, module, label):
    docs = spark.range(4000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"))
    docs = docs.unionAll(spark.range(1).select(F.lit(2).cast("long"), F.repeat(F.lit("long "), 20_000)))
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (2, 1, 1)], LABELS)
    rows = module.training_rows(docs, labels, F.lit(True)).collect()
    assert len(rows) == 2 and {r[label] for r in rows} == {0, 1}
