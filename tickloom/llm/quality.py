"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence comes from its own features and those of the lines before and after
it; neighbouring labels are tied by a 2 x 2 table. The chain is fitted to documents whose lines all carry the
document's label. To score, forward-backward gives each line its probability of being good; these are averaged,
weighted by line length, and one logistic curve fitted on the same sample turns the average into the score.

The fit uses a bounded sample: at most ``per_class`` labelled documents of each label, the first by a hash of
their id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, one_text_each, with_field

PER_CLASS, STEPS, L2 = 2000, 120, 1e-3

_LETTER, _DIGIT, _UPPER, _SPACE, _MARK = range(5)
_CLASS = np.full(256, _MARK, dtype=np.uint8)
_CLASS[0x80:] = _LETTER
_CLASS[ord("a"):ord("z") + 1] = _LETTER
_CLASS[ord("A"):ord("Z") + 1] = _UPPER
_CLASS[ord("0"):ord("9") + 1] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE

_SHARES = np.array([1e-9, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6])
_RATIOS = np.array([0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9, 0.97])
_MEANS = np.array([2.0, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 8.0, 12.0])
BINS = 16
GROUPS = 8  # length, marks, digits, capitals, distinct words, adjacent repeats, mean word length, last byte


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each feature group per line, bytes per line, and lines per document."""
    lines = [line for text in texts for line in text.split(b"\n")]
    count = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
    size = np.array([len(x) for x in lines], dtype=np.int64)
    joined = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    kind = _CLASS[joined]

    def share(k: int) -> np.ndarray:
        return np.add.reduceat((kind == k).view(np.uint8), start, dtype=np.int64) / np.maximum(size, 1)

    n_words, distinct, repeats = (np.zeros(len(lines)) for _ in range(3))
    for i, line in enumerate(lines):
        words = line.split()
        if words:
            n_words[i], distinct[i] = len(words), len(set(words))
            repeats[i] = sum(map(bytes.__eq__, words, words[1:]))
    some = np.maximum(n_words, 1)
    last = joined[np.maximum(start + size - 1, start)]
    ends = np.select([size == 0, last == ord("."), np.isin(last, list(b"?!")), _CLASS[last] == _MARK], [0, 1, 2, 3], 4)
    bins = np.stack([
        np.minimum(np.log2(size + 1).astype(np.int64), BINS - 1),
        np.digitize(share(_MARK), _SHARES), np.digitize(share(_DIGIT), _SHARES), np.digitize(share(_UPPER), _SHARES),
        np.digitize(distinct / some, _RATIOS), np.digitize(repeats / some, _SHARES),
        np.digitize(size / some, _MEANS), ends,
    ], axis=1)
    return bins + np.arange(GROUPS) * BINS, size, count


def _neighbours(bins: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Feature numbers of a line, the line before and the line after; one number stands for 'no such line'."""
    span = GROUPS * BINS
    end = np.cumsum(count)
    before, after = np.roll(bins, 1, axis=0) + span + 1, np.roll(bins, -1, axis=0) + 2 * span + 2
    if len(bins):
        before[end - count], after[end - 1] = 2 * span + 1, 3 * span + 2
    return np.concatenate([bins, before, after], axis=1)


WEIGHTS = 3 * GROUPS * BINS + 3


class Chain:
    """Weights of the field: evidence for 'good' by feature, a bias, and the table between neighbouring labels."""

    def __init__(self):
        self.w, self.bias, self.tie = np.zeros(WEIGHTS), 0.0, np.zeros((2, 2))

    def marginals(self, feats: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of 'good' per line, and the expected label pairs per document (document, 2, 2).

        All documents of the batch move one line forward together, longest first, then one line back.
        """
        good = 1 / (1 + np.exp(-np.clip(self.w[feats].sum(axis=1) + self.bias, -30, 30)))
        node = np.stack([1 - good, good], axis=1)
        step = np.exp(np.clip(self.tie, -20, 20))
        start = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        at, left = start[order], count[order]
        active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
        fore, back = np.empty_like(node), np.ones_like(node)
        for t, n in enumerate(active):
            i = at[:n] + t
            x = node[i] if t == 0 else node[i] * (fore[i - 1] @ step)
            fore[i] = x / x.sum(axis=1, keepdims=True)
        pairs = np.zeros((len(count), 2, 2))
        for t in range(len(active) - 2, -1, -1):
            i = at[:active[t + 1]] + t
            onward = node[i + 1] * back[i + 1]
            x = onward @ step.T
            joint = fore[i][:, :, None] * step[None] * onward[:, None, :]
            pairs[order[:active[t + 1]]] += joint / joint.sum(axis=(1, 2), keepdims=True)
            back[i] = x / x.sum(axis=1, keepdims=True)
        both = fore * back
        return both[:, 1] / both.sum(axis=1), pairs


def _average(p: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    start = np.cumsum(count) - count
    total = np.add.reduceat(size, start)
    return np.where(total > 0, np.add.reduceat(p * size, start) / np.maximum(total, 1), np.add.reduceat(p, start) / count)


class Model:
    """The fitted chain and the curve that turns a document's average into its score."""

    def __init__(self, chain: Chain, slope: float, shift: float):
        self.chain, self.slope, self.shift = chain, slope, shift

    def score(self, texts: list[bytes]) -> np.ndarray:
        bins, size, count = line_features(texts)
        p, _ = self.chain.marginals(_neighbours(bins, count), count)
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(_average(p, size, count)) + self.shift, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(texts: list[bytes], good: list[int], prior: float = 0.5) -> Model:
    """The chain and its curve, both fitted with the labels weighing alike; ``prior`` is the share of good labels."""
    chain, y = Chain(), np.array(good, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(chain, 0.0, 4.0 if len(y) and y[0] else -4.0)
    bins, size, count = line_features(texts)
    feats = _neighbours(bins, count)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) / count
    per_line, target = np.repeat(weight, count), np.repeat(y, count)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = ((count - 1) * weight)[y == label].sum()
    moment, scale = np.zeros(WEIGHTS + 5), np.zeros(WEIGHTS + 5)
    for step in range(1, STEPS + 1):
        p, pairs = chain.marginals(feats, count)
        error = (p - target) * per_line
        node = np.bincount(feats.ravel(), np.repeat(error, feats.shape[1]), WEIGHTS) + L2 * chain.w
        tie = (pairs * weight[:, None, None]).sum(axis=0) - seen + 0.05 * chain.tie
        full = np.concatenate([node, [error.sum()], tie.ravel()])
        moment, scale = 0.9 * moment + 0.1 * full, 0.999 * scale + 0.001 * full * full
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.999**step)) + 1e-9)
        chain.w, chain.bias = chain.w - move[:WEIGHTS], chain.bias - move[WEIGHTS]
        chain.tie = chain.tie - move[WEIGHTS + 1:].reshape(2, 2)
    p, _ = chain.marginals(feats, count)
    x, share = _logit(_average(p, size, count)), np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve with a little shrinkage
        q = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        g = np.array([((q - y) * share * x).sum() + 0.01 * (slope - 1), ((q - y) * share).sum() + 0.001 * shift])
        h = q * (1 - q) * share
        m = np.array([[(h * x * x).sum() + 0.01, (h * x).sum()], [(h * x).sum(), h.sum() + 0.001]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(m, g)
    return Model(chain, float(slope), float(shift) + float(_logit(np.array(prior))))


def known_labels(labels: DataFrame, learn: Column) -> DataFrame:
    """One label a document, the lower one: doc_id, quality."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & learn)
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    """At most ``per_class`` labelled documents of each label, the first by a hash of the id, one row each: text, quality."""
    known, picked = known_labels(labels, learn), None
    for label in (0, 1):
        part = known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    return one_text_each(docs, picked, "quality").select(F.col("text").cast("binary").alias("text"), "quality")


def quality(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    """Every row of ``docs`` (any columns) with ``quality_score`` from 0 to 1 added or replaced.

    ``learn`` says which rows of ``labels`` (doc_id, quality) may be learnt from. A null or empty text is one empty
    line; lines without bytes weigh nothing unless a document has no others. Equal texts score alike. An empty or
    one-sided set of labels gives a constant score. Repeated labels of a document count once, the lower one; of rows that
    repeat a labelled doc_id one is learnt from, and texts of more than ``common.FIT_BYTES`` bytes are only scored.
    """
    rows = training_rows(docs, labels, learn, per_class).toArrow()
    rows = sorted((t or b"", int(y)) for t, y in zip(rows.column("text").to_pylist(), rows.column("quality").to_pylist()))
    prior = known_labels(labels, learn).agg(F.avg("quality")).first()[0]
    model = fit([t for t, _ in rows], [y for _, y in rows], 0.5 if prior is None else prior)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        parts = [model.score([t or b"" for t in texts[i:i + 1000]]) for i in range(0, len(texts), 1000)]
        kept = [n for n in batch.schema.names if n != "quality_score"]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), pa.array(np.concatenate(parts), pa.float64())], [*kept, "quality_score"])

    docs = docs.drop("quality_score")
    return map_batches(docs, work, with_field(docs.schema, "quality_score", "double"))
