"""Toxicity score by a classifier that is held steady under swaps of identity terms.

A linear model over words and word prefixes is fitted to labelled documents. Every labelled sentence that names a
group gives a counterfactual in which the group's name is swapped for another of the same kind; the squared
change of the score between the two is added to the loss, so that naming a group moves the score little.

Where no labelled sentence names a group, names are put into the first ``PLANTED`` sentences of the sample instead, each
against the next of its kind.

The fit uses a bounded sample: at most ``per_class`` documents of each label, the first by a hash of their id, one row
each, of texts of up to ``common.FIT_BYTES`` bytes. Scores are of whole texts. Both labels weigh
alike in the loss, whatever the sample's balance; the bias is then shifted to the counted share of toxic labels, so a
score means the same at every input size.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, one_text_each, with_field

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")

#: Names of groups, each row of one kind; a name is swapped for the next of its row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "foreigners", "locals"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("christen", "muslime", "juden"), ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"), ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)

PER_CLASS, FEATURES, SWAP_WEIGHT, L2, STEPS = 2500, 6000, 1.0, 1e-3, 250
PLANTED = 500
MEMO = 200_000


def swaps_of(terms) -> dict[str, str]:
    """Each name with the next one of its row."""
    return {name: row[(i + 1) % len(row)] for row in terms for i, name in enumerate(row)}


SWAPS = swaps_of(IDENTITY_TERMS)


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings of three to six letters."""
    return ["=" + word, *(word[:n] for n in range(3, 7) if len(word) >= n)]


def _bag(words: set[str]) -> Counter:
    return Counter(f for w in words for f in word_features(w))


class _Rows:
    """Sparse rows with the two products a gradient needs."""

    def __init__(self, bags: Iterable[dict], index: dict[str, int]):
        row, col, val, self.n, self.d = array("i"), array("i"), array("d"), 0, len(index)
        for bag in bags:  # one document's features at a time
            for f, n in bag.items():
                if f in index:
                    row.append(self.n), col.append(index[f]), val.append(n)
            self.n += 1
        self.row, self.col = np.array(row, dtype=np.int64), np.array(col, dtype=np.int64)
        self.val = np.array(val, dtype=np.float64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.d)


def _change(words: set[str], swapped: set[str]) -> Counter:
    change = _bag(words)
    change.subtract(_bag(swapped))
    return change


def counterfactuals(text: str, swaps: dict[str, str] = SWAPS) -> list[Counter]:
    """For each sentence that names a group: its features less those of the swapped sentence."""
    out = []
    for sentence in SENTENCE.split(text.lower()):
        words = set(WORD.findall(sentence))
        if words & swaps.keys():
            out.append(_change(words, {swaps.get(w, w) for w in words}))
    return out


def planted(texts: Iterable[str], swaps: dict[str, str], most: int) -> list[Counter]:
    """``counterfactuals`` of sentences that names were put into: the first ``most`` sentences, names in turn."""
    out, names = [], sorted(swaps)
    for text in texts:
        for sentence in SENTENCE.split(text.lower()):
            words = set(WORD.findall(sentence))
            if words and names:
                name = names[len(out) % len(names)]
                out.append(_change(words | {name}, words | {swaps[name]}))
                if len(out) >= most:
                    return out
    return out


def fit(texts: list[str | None], toxic: list[int], prior: float | None = None, terms=IDENTITY_TERMS) -> tuple[dict[str, float], float]:
    """Weight of each feature, and the bias, for the score 1 / (1 + exp(-(bias + sum))).

    The labels weigh alike; ``prior`` is the share of toxic labels that the bias is shifted to, by default that of the rows.
    """
    texts = [t or "" for t in texts]
    y = np.array(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return {}, (4.0 if len(y) and y[0] else -4.0)
    seen = (Counter(), Counter())
    for text, label in zip(texts, toxic):
        seen[label].update(_bag(set(WORD.findall(text.lower()))).keys())
    n = np.array([max(1, len(y) - y.sum()), max(1, y.sum())])
    names = [f for f in {*seen[0], *seen[1]} if seen[0][f] + seen[1][f] >= 3]
    share = np.array([[seen[0][f], seen[1][f]] for f in names]).reshape(-1, 2)
    p = (share + 0.5) / (n + 1)
    both = (share.sum(axis=1) + 1) / (n.sum() + 2)
    z = np.abs(p[:, 1] - p[:, 0]) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    order = sorted(range(len(names)), key=lambda i: (-z[i], names[i]))[:FEATURES]
    index = {names[i]: k for k, i in enumerate(order)}
    del seen, share, p, both, z, names
    x = _Rows((_bag(set(WORD.findall(t.lower()))) for t in texts), index)
    swaps = swaps_of(terms)
    pairs = _Rows((c for t in texts for c in counterfactuals(t, swaps)), index)
    if not pairs.n:
        pairs = _Rows(planted(texts, swaps, PLANTED), index)

    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias = np.zeros(len(index)), 0.0
    moment, scale = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    for step in range(1, STEPS + 1):
        error = (1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30))) - y) * weight
        grad = x.back(error) + L2 * w
        if pairs.n:
            grad += 2 * SWAP_WEIGHT / pairs.n * pairs.back(pairs.dot(w))
        full = np.append(grad, error.sum())
        moment = 0.9 * moment + 0.1 * full
        scale = 0.999 * scale + 0.001 * full * full
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    prior = float(y.mean()) if prior is None else prior
    return {f: float(w[k]) for f, k in index.items()}, float(bias + np.log(prior / (1 - prior)))


class _Memo(dict):
    """Score of a word, worked out once; emptied when full, so memory stays bounded."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return value


def known_labels(labels: DataFrame, learn: Column) -> DataFrame:
    """One label a document, the higher one: doc_id, toxic."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learn)
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    """At most ``per_class`` labelled documents of each label, the first by a hash of the id, one row each: text, toxic."""
    known, picked = known_labels(labels, learn), None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    return one_text_each(docs, picked, "toxic")


def toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, terms=IDENTITY_TERMS
) -> DataFrame:
    """Every row of ``docs`` (any columns) with ``toxic_score`` from 0 to 1 added or replaced.

    ``learn`` says which rows of ``labels`` (doc_id, toxic) may be learnt from. A null or empty text has no words
    and scores as the bias says. Rows of one text always score alike. An empty or one-sided set of labels gives a
    constant score. Repeated labels of a document count once, the higher one; of rows that repeat a labelled doc_id one is
    learnt from. ``terms`` are the names of groups, each row of one kind.
    """
    rows = training_rows(docs, labels, learn, per_class).toArrow()
    rows = sorted(zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist()),
                  key=lambda r: (r[0] or "", r[1]))
    share = known_labels(labels, learn).agg(F.avg("toxic")).first()[0]
    weights, bias = fit([t for t, _ in rows], [int(y) for _, y in rows], share, terms)
    memo = _Memo(weights)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        raw = np.array([sum(map(memo.__getitem__, set(WORD.findall((t or "").lower())))) for t in texts])
        score = 1 / (1 + np.exp(-np.clip(raw + bias, -30, 30)))
        kept = [n for n in batch.schema.names if n != "toxic_score"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(score, pa.float64())],
                                          [*kept, "toxic_score"])

    docs = docs.drop("toxic_score")
    return map_batches(docs, work, with_field(docs.schema, "toxic_score", "double"))
