"""Ranked lexical search of many items against all documents by a dual-tree walk.

The score of a document for an item sums, over the item's terms, the term's weight times the document's saturated term
frequency, its impact. The items of a block make one tree: alike items lie side by side, batches of ``LEAF`` make a
node, ``FAN`` nodes the next, and a node holds the union of its items' terms. The documents of a task make trees of their
own, ``CHUNK`` at a time: a node holds the greatest impact of each term below it. A pair of nodes is bounded
by its terms' weights times these maxima, which no document below can exceed for any item below. If the bound is under the
weakest of those items' ``top``-th scores so far, the whole batch of documents is done for the whole batch of items.
Equal bounds are walked on, since a smaller doc_id wins a tie, so pruning is exact. Each task sends on its ``top``
documents per item, and these are ranked per item in the end.

Documents are first dealt by the part of the item tree that they share most words with, so that nodes hold documents
alike; a running number beside it splits any crowd, copies included, over many tasks. Items come in blocks of bounded
items and terms; only a block's terms are counted in the documents, in one pass over them for each block.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, portions, stored

#: Documents returned per item; items and distinct terms of a block; items in a leaf; nodes in a node; documents in a
#: leaf of theirs; numbers in a chunk's table of impacts.
TOP, ITEMS, TERMS, LEAF, FAN, DOCS, CELLS = 10, 4096, 16_384, 8, 4, 32, 4 << 20
_GAPS = bytes((*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
_PLAIN = bytes.maketrans(_GAPS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_GAPS) + b"abcdefghijklmnopqrstuvwxyz")
_GAP = re.compile(b"[" + re.escape(_GAPS) + b"]")


def term_counts(text: bytes | None) -> Counter:
    """How often each term (a run of digits, letters and bytes beyond ASCII, A-Z lowered) is in the whole text."""
    found: Counter = Counter()
    for part in portions(text or b"", _GAP):
        found.update(part.translate(_PLAIN).split())
    return found


def arranged(sets: list[set]) -> list[int]:
    """An order in which items with like terms are neighbours: groups are halved by the term that parts them most evenly."""
    order: list[int] = []
    todo = [list(range(len(sets)))]
    while todo:
        group = todo.pop()
        if len(group) > LEAF:
            held = Counter(t for i in group for t in sets[i])
            even, term = min((abs(2 * n - len(group)), t) for t, n in held.items())
            if even <= len(group) * 3 // 4:
                todo += [[i for i in group if term not in sets[i]], [i for i in group if term in sets[i]]]
                continue
            group.sort(key=lambda i: min((held[t], t) for t in sets[i]))
        order += group
    return order


class Items:
    """A block of items as a packed tree. ``levels`` go from single items up; each is (pointers, terms) of its nodes."""

    def __init__(self, rows: list[tuple[int, set]]):
        order = arranged([terms for _, terms in rows])
        self.numbers = [rows[i][0] for i in order]
        lists = [sorted(rows[i][1]) for i in order]
        self.vocabulary: dict[bytes, int] = {}
        for terms in lists:
            for t in terms:
                self.vocabulary.setdefault(t, len(self.vocabulary))
        sets = [{self.vocabulary[t] for t in terms} for terms in lists]
        self.levels = [self._packed(sets)]
        for fan in (LEAF, FAN, FAN):
            sets = [set().union(*sets[at:at + fan]) for at in range(0, len(sets), fan)]
            self.levels.append(self._packed(sets))
        held = np.bincount(self.levels[0][1], minlength=len(self.vocabulary))
        pointers, terms = self.levels[1]
        self.home = np.zeros(len(self.vocabulary), dtype=np.int64)
        leaf = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
        self.home[terms[::-1]] = leaf[::-1]  # the first leaf that has the term
        self.rare = 1.0 / held

    @staticmethod
    def _packed(sets: list[set]) -> tuple[np.ndarray, np.ndarray]:
        pointers = np.cumsum([0, *map(len, sets)])
        return pointers, np.array([t for s in sets for t in sorted(s)], dtype=np.int64)

    def count(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """doc_id, number of terms, and the block's terms in the document with their counts and home leaf."""
        sizes, ids, counts, homes = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = term_counts(text)
            mine = sorted((self.vocabulary[t], found[t]) for t in found.keys() & self.vocabulary.keys())
            sizes.append(found.total())
            ids.append([t for t, _ in mine])
            counts.append([n for _, n in mine])
            homes.append(int(np.bincount(self.home[ids[-1]], self.rare[ids[-1]]).argmax()) if mine else -1)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
             pa.array(counts, pa.list_(pa.int64())), pa.array(homes, pa.int32())], ["doc_id", "n", "ids", "tf", "home"])


class Best:
    """The ``top`` documents of every item so far, and the score that a further one must reach."""

    def __init__(self, items: int, top: int):
        self.top, self.need = top, np.ones(items, dtype=np.int64)
        self.held = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))  # item, score, null id, id

    def add(self, *new: np.ndarray) -> None:
        item, score, none, doc = (np.concatenate(x) for x in zip(self.held, new))
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        rank = np.arange(len(item)) - first
        keep = rank < self.top
        order = order[keep]
        self.held = item[keep], score[order], none[order], doc[order]
        last = rank == self.top - 1
        self.need[item[last]] = score[order][rank[keep] == self.top - 1]


def _spread(pointers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all terms of the nodes ``at``, how many each has, and where each begins."""
    many = pointers[at + 1] - pointers[at]
    begin = np.cumsum(many) - many
    return np.arange(many.sum()) + np.repeat(pointers[at] - begin, many), many, begin


def _below(at: np.ndarray, fan: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of each node, and which node of ``at`` each belongs to."""
    kids = at[:, None] * fan + np.arange(fan)
    owner = np.repeat(np.arange(len(at)), fan).reshape(kids.shape)
    return kids[kids < total], owner[kids < total]


class Search:
    """The dual-tree walk of a block of items over the documents of one task."""

    def __init__(self, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, top: int):
        self.levels, self.numbers, self.weight, self.top = items.levels, np.array(items.numbers), weight, top
        self.n_docs, self.n_terms = n_docs, n_terms
        self.chunk = max(1, min(64, CELLS // (DOCS * max(1, len(weight))))) * DOCS

    def _bounds(self, level: int, q: np.ndarray, most: np.ndarray, d: np.ndarray) -> np.ndarray:
        pointers, terms = self.levels[level]
        flat, many, begin = _spread(pointers, q)
        return np.add.reduceat(most[np.repeat(d, many), terms[flat]] * self.weight[terms[flat]], begin)

    def walk(self, rows: pa.Table, best: Best) -> None:
        """Merge the documents of one chunk into ``best``."""
        n, leaves = rows.num_rows, -(-rows.num_rows // DOCS)
        lists = rows.column("ids").combine_chunks()
        doc = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy(), rows.column("tf").combine_chunks().flatten().to_numpy()
        m = 10 + 90 * rows.column("n").to_numpy() * self.n_docs // self.n_terms
        impact = np.zeros((leaves, len(self.weight), DOCS), dtype=np.int64)
        impact[doc // DOCS, term, doc % DOCS] = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        most = [impact.max(axis=2)]
        for fan in (8, 8):
            most.append(np.maximum.reduceat(most[-1], np.arange(0, len(most[-1]), fan)))
        # item level, node table of the documents, children per node since the step before: items, documents
        steps = ((3, 2, 1, 1), (2, 1, FAN, 8), (1, 0, FAN, 8), (0, 0, LEAF, 1))
        total = len(self.levels[3][0]) - 1
        q, d = (x.ravel() for x in np.meshgrid(np.arange(total), np.arange(len(most[2])), indexing="ij"))
        for level, table, items, docs in steps:
            q, owner = _below(q, items, len(self.levels[level][0]) - 1)
            d, owner = _below(d[owner], docs, len(most[table]))
            q = q[owner]
            need = best.need
            for fan in (LEAF, FAN, FAN)[:level]:
                need = np.minimum.reduceat(need, np.arange(0, len(need), fan))
            keep = [np.zeros(0, dtype=bool)]
            for at in range(0, len(q), 1 << 12):
                part = slice(at, at + (1 << 12))
                keep.append(self._bounds(level, q[part], most[table], d[part]) >= need[q[part]])
            keep = np.concatenate(keep)
            q, d = q[keep], d[keep]
        none = rows.column("doc_id").combine_chunks()
        ids, none = none.fill_null(0).to_numpy(), none.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        pointers, terms = self.levels[0]
        for at in range(0, len(q), 1 << 12):
            a, b = q[at:at + (1 << 12)], d[at:at + (1 << 12)]
            flat, many, begin = _spread(pointers, a)
            t = terms[flat]
            score = np.add.reduceat(impact[np.repeat(b, many), t] * self.weight[t][:, None], begin, axis=0)
            i, slot = np.nonzero(score >= best.need[a][:, None])
            where = b[i] * DOCS + slot
            best.add(a[i], score[i, slot], none[where], ids[where])

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(self.numbers), self.top)
        for batch in batches:
            for at in range(0, batch.num_rows, self.chunk):
                self.walk(pa.Table.from_batches([batch.slice(at, self.chunk)]), best)
        item, score, none, doc = best.held
        if len(item):
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.numbers[item]), pa.array(doc, mask=none.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])


def _blocks(items: DataFrame) -> Iterator[tuple[list, Items]]:
    """Items with terms in blocks of at most ``ITEMS`` items and about ``TERMS`` distinct terms."""
    names, rows, seen = [], [], set()
    texts = items.select("item_id", F.col("text").cast("binary").alias("text"))
    for number, row in enumerate(texts.toLocalIterator()):
        terms = set(term_counts(row.text))
        if not terms:
            continue
        if rows and (len(rows) >= ITEMS or len(seen | terms) > TERMS):
            yield names, Items(rows)
            names, rows, seen = [], [], set()
        names.append((number, row.item_id))
        rows.append((number, terms))
        seen |= terms
    if rows:
        yield names, Items(rows)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents with a score above 0 of each row of ``items``: item_id, item (a number of that
    row), rank, doc_id, score; equal scores by ascending doc_id, a null one last.

    Null, empty and wordless texts have no terms: such items get no rows, such documents do not count. Rows that repeat
    an item_id or a doc_id are items and documents of their own. doc_id must be BIGINT. An empty table on either
    side gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"item_id {kind}, item long, rank int, doc_id long, score long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = []
    for names, block in _blocks(items):
        rows = stored(map_batches(texts, block.count, "doc_id long, n long, ids array<int>, tf array<long>, home int"))
        n_docs, n_terms = rows.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        weight = np.zeros(len(block.vocabulary), dtype=np.int64)
        for term, df in rows.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # of the block alone
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        if not n_docs:
            continue
        search = Search(block, weight, n_docs, n_terms, top)
        dealt = rows.filter("home >= 0").withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
        dealt = dealt.repartitionByRange("home", "salt").sortWithinPartitions("home", "salt")
        best = dealt.select("doc_id", "n", "ids", "tf").mapInArrow(search.run, "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        named = spark.createDataFrame(names, f"item long, item_id {kind}")
        found.append(best.join(F.broadcast(named), "item").select("item_id", "item", "rank", "doc_id", "score"))
    for more in found:
        empty = empty.unionAll(more)
    return empty
