"""Token ids in binary segments of patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id and sorted, so the order of partitions and of segments in them is the order of
the file. A segment holds about ``SEGMENT`` ids, whatever the sizes of its documents, and reads alone:

    "PFOR" | documents, ids, blocks, bytes of exceptions: 4 x uint32
    document table: doc_id int64 each | null flag uint8 each | number of ids uint32 each
    block index: start in the packed part uint32 each | first exception uint32 each
    per block: minimum uint32 | width uint8
    packed part: each block's ids less its minimum, ``width`` low bits each, lowest bit first
    exceptions: position in the block uint16 each, then the whole difference uint32 each

Spark's own writer puts segments in the rows of a Parquet table, so files land in any store, and a task that is run
again does not leave two copies. A document is never parted, so one longer than ``SEGMENT`` makes a longer segment.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import use_checkpoints

BLOCK, SEGMENT, PERCENTILE, END_ID = 256, 1 << 19, 90, 1
#: Pieces remembered at least; twice as many at most.
MEMO = 400_000
#: Latin text without what needs the library's care: combining marks, odd white space, special tokens.
_LATIN = range(0x180)
_LETTERS, _NUMBERS = (re.escape("".join(chr(c) for c in _LATIN if unicodedata.category(chr(c))[0] == k)) for k in "LN")
_CAREFUL = re.compile("[^\x00-\x1b\x20-\u017f]|<\\|")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


class Encoder(dict):
    """Packed ids of one piece of a text, worked out by the library's model and remembered. When full, what was
    remembered is put aside, and what is asked for again comes back from there.

    The tokenizer lowers case and parts a text into runs of letters, single digits and runs of other signs; no token
    reaches over these cuts. For Latin text the cuts are made here, by the tokenizer's own pattern, and each new piece is
    given to its model. Any other text is cut at spaces and new lines, which nothing reaches over either, and each new
    stretch goes through the whole library.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.spell = self.library.model, self.library.pre_tokenizer.pre_tokenize_str
        self.stretches: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.aside = dict(self)
            self.clear()
        if (value := self.aside.get(piece)) is not None:
            self[piece] = value
            return value
        spelt = piece if piece.isascii() and piece.isprintable() else self.spell(piece)[0][0]
        value = self[piece] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return value

    def _stretch(self, text: str) -> bytes:
        found = self.stretches.get(text)
        if found is None:
            if len(self.stretches) >= MEMO // 4:
                self.stretches.clear()
            found = self.stretches[text] = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        if _CAREFUL.search(text):
            return b"".join(map(self._stretch, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.__getitem__, _PIECE.findall(text.lower())))


@functools.lru_cache(maxsize=1)
def encoder_for(path: str) -> Encoder:
    """The worker's encoder: what it remembers serves the next task too."""
    return Encoder(path)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bits of each row's values one after the other, lowest bit first, in little-endian words."""
    low = np.ascontiguousarray(values.T) & np.uint32((1 << width) - 1)
    out = np.zeros((width * (BLOCK // 32), len(values)), dtype="<u4")
    for k, column in enumerate(low):
        word, shift = divmod(k * width, 32)
        out[word] |= column << np.uint32(shift)
        if shift + width > 32:
            out[word + 1] |= column >> np.uint32(32 - shift)
    return np.ascontiguousarray(out.T)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    """The values of rows that ``_packed`` made."""
    words = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, words.shape[1]), dtype=np.uint32)
    for k, column in enumerate(out):
        word, shift = divmod(k * width, 32)
        np.right_shift(words[word], np.uint32(shift), out=column)
        if shift + width > 32:
            column |= words[word + 1] << np.uint32(32 - shift)
    if width < 32:
        out &= np.uint32((1 << width) - 1)
    return out.T


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Block index, block heads, packed part and exceptions of ``ids``."""
    n = -(-len(ids) // BLOCK)
    whole = np.empty((n, BLOCK), dtype=np.uint32)
    whole.ravel()[:len(ids)] = ids
    whole.ravel()[len(ids):] = ids[-1] if len(ids) else 0
    least = whole.min(axis=1) if n else np.zeros(0, dtype=np.uint32)
    rest = whole - least[:, None]
    mark = np.sort(rest, axis=1)[:, (BLOCK * PERCENTILE - 1) // 100] if n else least
    width = np.ceil(np.log2(mark.astype(np.float64) + 1)).astype(np.uint8)
    most = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    outlier = rest > most[:, None]
    at = np.nonzero(outlier)
    exceptions = at[1].astype("<u2").tobytes() + rest[at].astype("<u4").tobytes()
    first = np.cumsum(outlier.sum(axis=1)) - outlier.sum(axis=1)
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.cumsum(size) - size
    packed = np.zeros(int(size.sum()), dtype=np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            out = _packed(rest[rows], int(w)).view(np.uint8)
            packed[start[rows][:, None] + np.arange(out.shape[1])] = out
    heads = least.astype("<u4").tobytes() + width.tobytes()
    return start.astype("<u4").tobytes() + first.astype("<u4").tobytes(), heads, packed.tobytes(), exceptions


def write_segment(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    index, heads, packed, exceptions = pack(ids)
    head = np.array([len(doc_ids), len(ids), -(-len(ids) // BLOCK), len(exceptions)], dtype="<u4").tobytes()
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
    return b"".join([b"PFOR", head, names, nulls, np.array(counts, dtype="<u4").tobytes(),
                     index, heads, packed, exceptions])


class Segment:
    """A segment's tables; ids are unpacked on demand, only for the blocks asked for."""

    def __init__(self, data: bytes):
        if data[:4] != b"PFOR":
            raise ValueError("not a token segment")
        self.data, self.at = data, 4
        n, self.n_ids, blocks, extra = (int(x) for x in self._take("<u4", 4))
        names, nulls = self._take("<i8", n), self._take("u1", n)
        self.doc_ids = [None if z else int(d) for d, z in zip(names, nulls)]
        self.counts = self._take("<u4", n).astype(np.int64)
        self.start, self.first = self._take("<u4", blocks), self._take("<u4", blocks)
        self.least, self.width = self._take("<u4", blocks), self._take("u1", blocks)
        self.packed = self._take("u1", int(self.width.sum(dtype=np.int64)) * (BLOCK // 8))
        self.where, self.what = self._take("<u2", extra // 6), self._take("<u4", extra // 6)

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def ids(self, first: int = 0, past: int | None = None) -> np.ndarray:
        """Ids ``first`` up to, not including, ``past``."""
        past = self.n_ids if past is None else past
        low, high = first // BLOCK, -(-past // BLOCK)
        rest = np.zeros((high - low, BLOCK), dtype=np.uint32)
        width = self.width[low:high]
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                nbytes = int(w) * (BLOCK // 8)
                raw = self.packed[self.start[low:high][rows].astype(np.int64)[:, None] + np.arange(nbytes)]
                rest[rows] = _unpacked(raw.view("<u4"), int(w))
        if high > low:
            to = int(self.first[high]) if high < len(self.first) else len(self.where)
            frm = int(self.first[low])
            count = np.diff(np.append(self.first[low:high].astype(np.int64), to))
            rest[np.repeat(np.arange(high - low), count), self.where[frm:to]] = self.what[frm:to]
        return (rest + self.least[low:high][:, None]).ravel()[first - low * BLOCK:past - low * BLOCK]


SEGMENTS = "part int, seq int, before long, n_ids long, data binary"


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_for(path), TaskContext.get().partitionId()
        end = np.array([END_ID], dtype="<u4").tobytes()
        names, held, size, seq, before = [], [], 0, 0, 0

        def cut() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            data = write_segment(names, [len(x) // 4 for x in held], ids)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                 "before": pa.array([before], pa.int64()), "n_ids": pa.array([size], pa.int64()),
                 "data": pa.array([data], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(doc_id)
                held.append(encoder.encode(text.as_py() or "") + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT:
                    yield cut()
                    seq, before = seq + 1, before + size
                    names, held, size = [], [], 0
        if names:
            yield cut()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Ids of every text, each with ``END_ID`` after it, as segments in ascending doc_id order below ``path``.

    Null doc_ids come first; rows of one doc_id follow each other in the order of their texts. A null text is empty and
    has the end id alone. Other columns are ignored. ``tokenizer`` is the vocabulary file's place, the same on every machine. No rows: no segments.
    """
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_write(tokenizer), SEGMENTS).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in zip(batch.column("base").to_pylist(), batch.column("data")):
            segment = Segment(data.as_buffer().to_pybytes())
            ids = segment.ids().astype("<u4").tobytes()
            past = np.cumsum(segment.counts)
            first = past - segment.counts
            chunks = [ids[4 * a:4 * b] for a, b in zip(first.tolist(), past.tolist())]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(segment.doc_ids, pa.int64()), "start": pa.array(base + first, pa.int64()),
                 "n_tokens": pa.array(segment.counts, pa.int64()), "ids": pa.array(chunks, pa.binary())})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian uint32) of every document."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each task that wrote
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    rows = segments.join(F.broadcast(bases), "part").select((F.col("first") + F.col("before")).alias("base"), "data")
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def new_path(spark: SparkSession) -> str:
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
