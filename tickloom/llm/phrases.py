"""Phrase collocations from an index per shard over word ids.

A shard is the pieces of one language of part of the documents, a bounded number of words, as one sequence of word ids with
a 0 after each piece. Its index is the Burrows-Wheeler transform of that sequence with rotations sorted by their first
``DEEPEST`` symbols: all rows that begin with one phrase are one interval, and the interval's length is the
phrase's count. The transform alone gives both ways back: sorting it stably gives each row's first symbol and the row of
the rotation one word further right. So an interval is extended to the right by what stands one row step on,
and to the left by the transform itself, for all intervals at once.

Phrases grow by one word a pass: one of at least ``least`` places has only such parts. The intervals of the words that
are frequent over all shards are extended to pairs, whose counts are summed across shards; the intervals of frequent pairs are
extended to 3 words, and so on, so only phrases whose two parts of one word less are frequent are ever counted. Each is named by
these two parts. A word's intervals are summed by a
window over them, so those of frequent words are at hand for their shards without a join. Frequent pairs are sent to all tasks as sorted numbers if their counted bytes are within
``LOOKUP_BYTES``, and reach the shards by a join of the pairs' intervals beyond it, as longer phrases do. Counts, cuts, containment and ranks
are joins and groups over the frequent phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import portions, stored

#: Longest phrase; least places; symbols of a shard; phrases returned per language; parts in which these are first ranked.
DEEPEST, LEAST, SHARD, FIRST, PARTS = 5, 100, 1 << 22, 2000, 64
#: Frequent pairs that are sent to every task: at most so many bytes, at 24 each.
LOOKUP_BYTES = 64 << 20
NO_LANG = "und"
_MARKS = b".,;:!?\n\x0b\x0c\r"
# every mark becomes a point, which stands apart and is no part of any word
_PLAIN = bytes.maketrans(_MARKS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * len(_MARKS) + b" abcdefghijklmnopqrstuvwxyz")
_GAP = re.compile(b"[ \t" + re.escape(_MARKS) + b"]")
#: What a shard gives first: its words with their intervals, and one row with the transform.
INDEX = "shard long, lang string, word string, lo int, n int, bwt binary"
#: Intervals of phrases, each named by the ids of the phrases without its last and without its first word.
RUNS = "shard long, lo int, n int, a long, b long"


class Words(dict):
    """Ids by first sight; the point, which parts pieces, is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def word_ids(text: bytes | None, words: Words) -> Iterator[np.ndarray]:
    """The text's word ids with 0 between pieces and at the end, in parts of bounded size."""
    for part in portions(text or b"", _GAP):
        found = part.translate(_PLAIN).replace(b".", b" . ").split()
        yield np.fromiter(map(words.__getitem__, found), np.int32, len(found))
    yield np.zeros(1, dtype=np.int32)


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    new = np.empty(len(keys), dtype=np.int64)
    new[0] = 0
    new[1:] = keys[order][1:] != keys[order][:-1]
    out = np.empty_like(new)
    out[order] = np.cumsum(new)
    return out


def transform(ids: np.ndarray) -> np.ndarray:
    """The symbol before each rotation, rotations sorted by their first five symbols."""
    one = ids.astype(np.int64)
    many = int(one.max()) + 1
    two = _ranks(one * many + np.roll(one, -1))
    four = _ranks(two * (int(two.max()) + 1) + np.roll(two, -2))
    order = np.argsort(four * many + np.roll(one, -4))
    return ids[order - 1]


def steps(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First symbol of each row, and the row of the rotation one symbol further right."""
    both = np.sort((bwt.astype(np.int64) << 32) | np.arange(len(bwt)))
    return both >> 32, both & 0xFFFFFFFF


def _packed(bwt: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(bwt.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    planes = pa.decompress(data, decompressed_size=4 * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


class _Open:
    """A shard that still takes documents."""

    def __init__(self):
        self.words, self.parts, self.size = Words(), [], 0

    def add(self, text: bytes | None) -> None:
        for part in word_ids(text, self.words):
            self.parts.append(part)
            self.size += len(part)

    def rows(self, shard: int, lang: str) -> Iterator[pa.RecordBatch]:
        """The finished shard. Ids are dealt anew, frequent words first, which packs better."""
        ids = np.concatenate(self.parts)
        held = np.bincount(ids, minlength=len(self.words))
        order = np.concatenate(([0], 1 + np.argsort(-held[1:], kind="stable")))
        new = np.empty_like(order)
        new[order] = np.arange(len(order))
        held = held[order]
        lo = np.cumsum(held) - held
        names = list(self.words)
        k = len(names) - 1
        yield self._batch(shard, lang, [names[i] for i in order[1:].tolist()], lo[1:], held[1:], [None] * k)
        yield self._batch(shard, lang, [None], [-1], [len(ids)], [_packed(transform(new[ids].astype(np.int32)))])

    @staticmethod
    def _batch(shard, lang, words, lo, n, bwt) -> pa.RecordBatch:
        k = len(words)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, shard)), pa.array([lang] * k, pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
             pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(bwt, pa.binary())],
            ["shard", "lang", "word", "lo", "n", "bwt"])


def _index(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        shards: dict[str, _Open] = {}
        total = 0

        def finish(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made, total
            shard = shards.pop(lang)
            total -= shard.size
            made += 1
            yield from shard.rows((task << 32) + made, lang)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                shard = shards.setdefault(lang, _Open())
                total -= shard.size
                shard.add(text.as_py())
                total += shard.size
                if shard.size >= size:
                    yield from finish(lang)
                while total >= 2 * size:
                    yield from finish(max(shards, key=lambda x: shards[x].size))
        for lang in list(shards):
            yield from finish(lang)

    return run


def _runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each stretch of rows that agree in all columns."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(new)))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each shard's number, the id of the frequent phrase that each row begins with (0: none), and the row one symbol
    further right. Rows come sorted by shard and lo, the transform first; shards without frequent phrases are passed over."""
    shard = packed = size = None
    held: list[pa.RecordBatch] = []

    def whole():
        ids = np.zeros(size, dtype=np.int64)
        for x in held:
            lo, n = x.column("lo").to_numpy().astype(np.int64), x.column("n").to_numpy().astype(np.int64)
            ids[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)] = np.repeat(x.column("id").to_numpy(), n)
        return shard, ids, steps(_unpacked(packed, size))[1]

    for batch in batches:
        numbers = batch.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if numbers[a] != shard:
                if held:
                    yield whole()
                shard, held = int(numbers[a]), []
                packed, size = batch.column("bwt")[a].as_py(), batch.column("n")[a].as_py()
                a += 1
            if b > a:
                held.append(batch.slice(a, b - a).select(["lo", "n", "id"]))
    if held:
        yield whole()


def _pair_runs(ids: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of phrases whose two parts are frequent: first row, length, and the ids of both parts."""
    on = ids[right]
    row = np.flatnonzero((ids > 0) & (on > 0))
    a, b = ids[row], on[row]
    start, n = _runs([a, b])
    return row[start], n, a[start], b[start]


class PairIds:
    """Ids of the frequent pairs by the ids of their words."""

    def __init__(self, a: np.ndarray, b: np.ndarray, pair: np.ndarray):
        self.a, at = np.unique(a, return_inverse=True)
        self.b, on = np.unique(b, return_inverse=True)
        key = at * len(self.b) + on
        order = np.argsort(key)
        self.key, self.pair = key[order], pair[order]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs' ids, 0 where a pair is not frequent."""
        def place(values, sought):
            at = np.minimum(np.searchsorted(values, sought), len(values) - 1)
            return at, values[at] == sought

        (at, known), (on, also) = place(self.a, a), place(self.b, b)
        found, there = place(self.key, at * len(self.b) + on)
        return np.where(known & also & there, self.pair[found], 0)


def _longer(lookup=None):
    """Intervals of frequent phrases to those of phrases one word longer: shard, lo, n, and the ids of the phrases without the last
    and without the first word. With a ``lookup`` the rows bring frequent words, which first become frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, right in _shards(batches):
            if lookup is not None:
                lo, n, a, b = _pair_runs(ids, right)
                ids = np.zeros(len(ids), dtype=np.int64)
                ids[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)] = np.repeat(lookup.value.of(a, b), n)
            lo, n, a, b = _pair_runs(ids, right)
            for at in range(0, len(lo), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lo[part]), shard)), pa.array(lo[part], pa.int32()), pa.array(n[part], pa.int32()),
                     pa.array(a[part]), pa.array(b[part])], ["shard", "lo", "n", "a", "b"])

    return run


def _extended(shards: DataFrame, intervals: DataFrame, work) -> DataFrame:
    """``work`` over every shard with its intervals (shard, lo, n, id)."""
    rows = shards.select("shard", "lo", "n", F.lit(None).cast("long").alias("id"), "bwt")
    rows = rows.unionAll(intervals.select("shard", "lo", "n", "id", F.lit(None).cast("binary")))
    # no join before it, which would shuffle the transforms once more
    return rows.repartition("shard").sortWithinPartitions("shard", "lo").mapInArrow(work, RUNS)


def _frequent(runs: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """Phrases with at least ``least`` places in ``runs``, named by the frequent ``parts`` a and b: a, b, lang, phrase, last, f, id."""
    many = runs.groupBy("a", "b").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    many = many.join(parts.select(F.col("id").alias("a"), "lang", "phrase"), "a").join(parts.select(F.col("id").alias("b"), "last"), "b")
    many = many.select("a", "b", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f")
    return stored(many.withColumn("id", F.monotonically_increasing_id() + 1))


def _intervals(runs: DataFrame, frequent: DataFrame) -> DataFrame:
    return runs.join(frequent.select("a", "b", "id"), ["a", "b"]).select("shard", "lo", "n", "id")


def frequent_phrases(docs: DataFrame, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``DEEPEST`` words with at least ``least`` places (lang, phrase, size, f), and each language's
    number of words (lang, n)."""
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text"))
    index = stored(texts.mapInArrow(_index(shard), INDEX))
    words = index.filter("lo >= 0").select("shard", "lang", "word", "lo", "n", F.monotonically_increasing_id().alias("row"))
    shards = index.filter("lo < 0").select("shard", "lo", "n", "bwt")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")))
    # a word has one row in each shard that holds it, and is named by the first of them
    word = Window.partitionBy("lang", "word")
    marked = words.withColumns({"f": F.sum("n").over(word), "id": F.min("row").over(word) + 1}).filter(F.col("f") >= least)
    marked = stored(marked.withColumn("first", F.col("row") + 1 == F.col("id")).drop("row"))
    one = marked.filter("first").select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", "id")
    of_words = marked.select("shard", "lo", "n", "id")
    runs = _extended(shards, of_words, _longer())
    two = _frequent(runs, one, least)
    if 0 < two.count() <= LOOKUP_BYTES // 24:
        known = two.select("a", "b", "id").toArrow()
        lookup = docs.sparkSession.sparkContext.broadcast(PairIds(*(known.column(c).to_numpy() for c in ("a", "b", "id"))))
        runs = _extended(shards, of_words, _longer(lookup))
    else:
        runs = _extended(shards, _intervals(runs, two), _longer())
    found = [one, two]
    for size in range(3, DEEPEST + 1):
        if size > 3:
            runs = _extended(shards, _intervals(runs, found[-1]), _longer())
        runs = stored(runs)  # taken twice, to be summed and for the intervals of the frequent ones
        found.append(_frequent(runs, found[-1], least))
    named = [x.select("lang", "phrase", F.lit(i + 1).alias("size"), "f") for i, x in enumerate(found)]
    return stored(reduce(DataFrame.unionAll, named)), totals


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, shard: int = SHARD) -> DataFrame:
    """The ``first`` best phrases of 2 to 5 words of each language: lang, rank, phrase, a, l, r, n, score.

    A null lang is ``und``, also where that is written. Null, empty and wordless texts add no words. Repeated rows all count.
    doc_id and other columns are ignored. A phrase never crosses a mark or the end of a text. An empty table gives no
    rows. A piece (text between two marks) stays whole, so the longest one bounds a shard from below.
    """
    found, totals = frequent_phrases(docs, least, shard)
    words = F.split("phrase", " ")
    candidates = found.filter("size > 1")
    cut = candidates.select("lang", "phrase", "f", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "f", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                     F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    part = found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    cut = cut.join(part, ["lang", "head"])
    cut = cut.join(part.withColumnsRenamed({"head": "rest", "l": "r"}), ["lang", "rest"]).join(totals, "lang")
    # whole numbers of up to 38 digits; the quotient is at most 10 * n and fits a long
    wide = "decimal(38,0)"
    over = (F.col("f").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    under = F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")
    cut = cut.withColumns({"over": over.cast(wide), "under": under.cast(wide)})
    cut = cut.withColumn("score", F.expr("over div under"))
    scored = cut.groupBy("lang", "phrase", "f", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    longer = candidates.filter("size > 2").select("lang", "f", words.alias("w"))
    inside = longer.select("lang", "f", F.explode(F.array(
        F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "),
        F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))).alias("phrase"))
    # a phrase in a longer one with as many places also is in one that is longer by a word
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") < F.col("f")))
    kept = kept.select("lang", "phrase", F.col("f").alias("a"), "low.l", "low.r", "n", "low.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each part's first, then the first of those: no task ranks a whole language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best)
    kept = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= first)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= first)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
