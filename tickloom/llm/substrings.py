"""Removal of long substrings that occur more than once, by column-wise suffix sorting of a collection.

Every start of a ``WINDOW``-byte string is given to the smallest-hashed ``GRAM`` inside it (its anchor); starts that share an
anchor form one range, so a text is parted into ranges. Equal strings have equal anchors at equal distance. So ranges
with one anchor, laid side by side with their anchors in one column, make a small collection of documents: two equal
strings begin in the same column of it.

Such a collection is sorted column by column from the right. Each round puts one symbol before every document's suffix:
the column of symbols in suffix order is the round's part of the collection's Burrows-Wheeler transform, a stable
sort by it gives the next order, and common prefixes grow by one where neighbours took the same symbol
(``rounds``). Neighbours whose common prefix reaches ``WINDOW`` start equal strings.

Ranges whose whole text occurs again are found beforehand by one aggregation, so copies do not enter a collection. A
collection above ``CROWD`` different ranges is not gathered in one task: it is sorted in parts, and what a string of one part has
in another is found by digests, of blocks of ``BLOCK`` starts first and then of the strings in blocks that match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, grouped, map_batches, stored, with_field

WINDOW, GRAM, CROWD, BLOCK, PORTION, RANGES = 400, 32, 256, 16, 1 << 20, 8192
_POSITION = 24  # low bits of a sort key hold the place; PORTION plus a window must fit
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.full(PORTION + (1 << 16), _BASE, dtype=np.uint64)
_STEP[0] = 1
_INVERSE = np.full(len(_STEP), pow(_BASE, -1, 1 << 64), dtype=np.uint64)
_INVERSE[0] = 1
_STEP, _INVERSE = np.cumprod(_STEP, dtype=np.uint64), np.cumprod(_INVERSE, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hash of every ``gram`` bytes in a row."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(data.astype(np.uint64) * _STEP[:n], out=sums[1:])
    h = (sums[gram:] - sums[:n - gram + 1]) * _INVERSE[:n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def ranges(data: np.ndarray, first: np.ndarray, past: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Ranges of string starts in pieces [first, past) of ``data``: first start, last start, place and hash of the anchor."""
    h = gram_hashes(data, gram)
    key = (h >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(len(h), dtype=np.uint64)
    span, size = window - gram + 1, 1
    while size * 2 <= span:
        key, size = np.minimum(key[:-size], key[size:]), size * 2
    if size < span:
        key = np.minimum(key[:len(key) - (span - size)], key[span - size:])
    anchor = (key & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    new = np.append(True, np.diff(anchor) != 0)
    new[first] = True
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[first] += 1
    inside[past - window + 1] -= 1
    valid = np.cumsum(inside[:len(anchor)]) > 0
    start = np.flatnonzero(new & valid)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    return start, stop, anchor[start], h[anchor[start]].view(np.int64)


def _find(window: int, gram: int):
    def portions(doc_ids: list, hashes: list, texts: list) -> Iterator[list]:
        held, size = [], 0
        for doc_id, h, text in zip(doc_ids, hashes, texts):
            for at in range(0, len(text) - window + 1, PORTION):
                piece = text[at:at + PORTION + window - 1]
                if held and size + len(piece) > PORTION:
                    yield held
                    held, size = [], 0
                held.append((doc_id, h, at, piece))
                size += len(piece)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = batch.column("text").to_pylist()
            for part in portions(batch.column("doc_id").to_pylist(), batch.column("_tl_h").to_pylist(), texts):
                whole = b"".join(p[3] for p in part)
                size = np.array([len(p[3]) for p in part])
                past = np.cumsum(size)
                first = past - size
                start, stop, anchor, h = ranges(np.frombuffer(whole, dtype=np.uint8), first, past, window, gram)
                owner = np.searchsorted(past, start, "right")
                base = np.array([p[2] for p in part]) - first
                digest = xxhash.xxh3_64_intdigest
                seg = np.array([digest(whole[u:v + window], o) for u, v, o in
                                zip(start.tolist(), stop.tolist(), (anchor - start).tolist())], dtype=np.uint64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([p[0] for p in part], batch.schema.field("doc_id").type).take(pa.array(owner)),
                    "_tl_h": pa.array([p[1] for p in part], pa.int64()).take(pa.array(owner)),
                    "u": pa.array(start + base[owner], pa.int64()), "size": pa.array(stop - start + window, pa.int32()),
                    "off": pa.array(anchor - start, pa.int32()), "anchor": pa.array(h, pa.int64()),
                    "seg": pa.array(seg.view(np.int64), pa.int64())})

    return run


def rounds(symbols: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Column-wise construction over ``symbols`` (column, document; 0 where a document has none), from the last column.

    Documents of different ``bucket`` (ascending) are different collections. Yields the column, the documents in the order
    of their suffixes from there, the common prefix of each with the one before, and the symbols put in.
    """
    order, common = np.arange(symbols.shape[1]), np.zeros(symbols.shape[1], dtype=np.int32)
    bucket = bucket.astype(np.int32) * 258
    for c in range(len(symbols) - 1, -1, -1):
        put = symbols[c][order]
        key = bucket[order] + put
        move = np.argsort(key, kind="stable")
        former, now = move[:-1], move[1:]
        pair = np.flatnonzero((key[former] == key[now]) & (put[now] > 0))
        low, high = former[pair] + 1, now[pair]
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1  # largest power of two within the stretch
        least = np.empty(len(pair), dtype=np.int32)
        table = common
        for k in range(int(level.max(initial=0)) + 1):
            if k:
                half = 1 << (k - 1)
                table = np.minimum(table[:-half], table[half:])
            at = np.flatnonzero(level == k)
            least[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        common = np.zeros_like(common)
        common[pair + 1] = least + 1
        order = order[move]
        yield c, order, common, put[move]


def repeated(bucket: np.ndarray, off: np.ndarray, segs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(range, start in it) of every string of ``window`` bytes that another range of its bucket holds in the same column."""
    left = int(off.max())
    first = left - off
    size = np.array([len(s) for s in segs])
    symbols = np.zeros((int((first + size).max()), len(segs)), dtype=np.uint16)
    for j, s in enumerate(segs):
        symbols[first[j]:first[j] + len(s), j] = np.frombuffer(s, dtype=np.uint8)
        symbols[first[j]:first[j] + len(s), j] += 1
    rows, starts = [], []
    for c, order, common, _ in rounds(symbols, bucket):
        if c + window > len(symbols):
            continue
        same = common >= window
        if same.any():
            hit = order[same | np.append(same[1:], False)]
            rows.append(hit)
            starts.append(c - first[hit])
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(rows), np.concatenate(starts)


def _blocks(off: int, seg: bytes, hit: np.ndarray, window: int) -> Iterator[tuple[int, int, bool]]:
    """Blocks of ``BLOCK`` columns that hold starts of a range: first column, digest of what all strings that
    start in the block have in common, and whether some of the range's own is still without a partner."""
    count = len(seg) - window + 1
    whole = np.zeros(count, dtype=bool)
    whole[hit] = True
    first = -off // BLOCK * BLOCK
    for a in range(first, count - off, BLOCK):
        low, high = max(0, a + off), min(count, a + off + BLOCK)
        core = seg[max(0, a + off + BLOCK - 1):max(0, a + off + window)]
        yield a, xxhash.xxh3_64_intdigest(core, a & 0xFFFFFFFF), not whole[low:high].all()


def _sort(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "bucket", RANGES):
            rows = rows.combine_chunks()
            key, off, segs = rows.column("bucket").to_numpy(), rows.column("off").to_numpy(), rows.column("bytes").to_pylist()
            bucket = np.cumsum(np.append(0, np.diff(key) != 0))
            row, start = repeated(bucket, off, segs, window)
            order = np.lexsort((start, row))
            row, start = row[order], start[order]
            u = rows.column("u").to_numpy()
            at = np.flatnonzero(np.append(len(row) > 0, (np.diff(row) != 0) | (np.diff(start) != 1)))  # starts in a row: one mark
            ends = np.append(at[1:], len(row))[:len(at)] - 1
            owner, first, past = list(row[at]), list(u[row[at]] + start[at]), list(u[row[at]] + start[ends] + window)
            column, digest, open_ = ([None] * len(owner) for _ in range(3))
            crowded = np.flatnonzero(rows.column("crowded").to_numpy())
            for j, low, high in zip(crowded, np.searchsorted(row, crowded), np.searchsorted(row, crowded, "right")):
                for a, d, more in _blocks(int(off[j]), segs[j], start[low:high], window):
                    owner.append(j), first.append(u[j]), past.append(None), column.append(a)
                    digest.append(d - (1 << 64) if d >> 63 else d), open_.append(more)
            if owner:
                who = pa.array(np.array(owner, dtype=np.int64))
                yield pa.RecordBatch.from_pydict({
                    **{n: rows.column(n).combine_chunks().take(who) for n in ("doc_id", "_tl_h", "anchor")},
                    "first": pa.array(first, pa.int64()), "past": pa.array(past, pa.int64()), "column": pa.array(column, pa.int32()),
                    "digest": pa.array(digest, pa.int64()), "open": pa.array(open_, pa.bool_())})

    return run


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, asked = batch.column("text").to_pylist(), batch.column("asked")
    count = np.array([len(a) for a in asked])
    flat = asked.flatten()  # of the slice alone
    owner = np.repeat(np.arange(len(texts)), count)
    u, size = flat.field("u").to_numpy(), flat.field("size").to_numpy()
    parts = [texts[o][a:a + n] for o, a, n in zip(owner.tolist(), u.tolist(), size.tolist())]
    who = pa.array(owner)
    return pa.RecordBatch.from_pydict({
        "doc_id": batch.column("doc_id").take(who), "_tl_h": batch.column("_tl_h").take(who), "u": pa.array(u),
        **{n: flat.field(n) for n in ("off", "anchor", "crowded", "bucket")}, "bytes": pa.array(parts, pa.binary())})


def _digests(window: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest, out = xxhash.xxh3_64_intdigest, []
        for s, off, columns in zip(*(batch.column(n).to_pylist() for n in ("bytes", "off", "columns"))):
            starts = [i for a in columns for i in range(max(0, a + off), min(len(s) - window + 1, a + off + BLOCK))]
            out.append([{"i": i, "digest": d - (1 << 64) if d >> 63 else d} for i in starts for d in [digest(s[i:i + window])]])
        kind = pa.list_(pa.struct([("i", pa.int32()), ("digest", pa.int64())]))
        names = ["doc_id", "_tl_h", "u", "off", "anchor"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, kind)], [*names, "digests"])

    return work


def repeated_marks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, _tl_h (hash of the text), first, past: byte stretches covered by strings that also start elsewhere."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("_tl_h"), F.col("text").cast("binary").alias("text"))
    texts = texts.filter(F.octet_length("text") >= window)
    found = stored(texts.mapInArrow(
        _find(window, gram), f"doc_id {kind}, _tl_h long, u long, size int, off int, anchor long, seg long"))
    often = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("total")).filter("total > 1"))
    some = stored(found.join(often, "anchor").drop("total"))
    place = F.struct("doc_id", "_tl_h", "u", "size", "off")
    segs = stored(some.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p")))
    copied = stored(segs.filter("n > 1").select("anchor", "seg"))
    marks = some.join(copied, ["anchor", "seg"]).select("doc_id", "_tl_h", F.col("u").alias("first"), (F.col("u") + F.col("size")).alias("past"))

    sizes = stored(segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    # a crowded collection is parted by a hash, so no task gathers it whole
    parts = F.ceil(F.col("m") / crowd).cast("int")
    place = F.xxhash64("p.doc_id", "p._tl_h", "p.u")
    ask = segs.join(sizes, "anchor").select("p.doc_id", "p._tl_h", F.struct(
        "p.u", "p.size", "p.off", "anchor", (F.col("m") > crowd).alias("crowded"),
        F.xxhash64("anchor", F.pmod(place, parts)).alias("bucket")).alias("a"))
    ask = ask.groupBy("doc_id", "_tl_h").agg(F.collect_list("a").alias("asked"))  # as many as the text has ranges
    named = ask.select(F.col("doc_id").alias("_d"), F.col("_tl_h").alias("_h"), "asked")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_tl_h") == F.col("_h"))
    cut = stored(map_batches(texts.join(named, same).drop("_d", "_h"), _cut,
                             f"doc_id {kind}, _tl_h long, u long, off int, anchor long, crowded boolean, bucket long, bytes binary"))
    found = stored(cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _sort(window), f"doc_id {kind}, _tl_h long, anchor long, first long, past long, column int, digest long, open boolean"))
    marks = marks.unionAll(found.filter("past is not null").select("doc_id", "_tl_h", "first", "past"))

    # strings of different parts: first whole blocks of starts by what they share, then the strings of blocks that match
    block = ["anchor", "column", "digest"]  # 64 bits of the anchor and 64 of the bytes
    blocks = found.filter("past is null").select("doc_id", "_tl_h", F.col("first").alias("u"), "open", *block)
    match = blocks.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("open"))
    match = stored(match.filter("n > 1 and open").select(*block))
    if match.isEmpty():
        return marks
    again = blocks.join(match, block).groupBy("doc_id", "_tl_h", "u").agg(F.collect_list("column").alias("columns"))
    again = again.select(F.col("doc_id").alias("_d"), F.col("_tl_h").alias("_h"), F.col("u").alias("_u"), "columns")
    crowded = cut.filter("crowded")
    same = crowded["doc_id"].eqNullSafe(F.col("_d")) & (crowded["_tl_h"] == F.col("_h")) & (crowded["u"] == F.col("_u"))
    each = map_batches(crowded.join(again, same).drop("_d", "_h", "_u", "crowded", "bucket"), _digests(window),
                       f"doc_id {kind}, _tl_h long, u long, off int, anchor long, digests array<struct<i:int,digest:long>>")
    each = stored(each.select("doc_id", "_tl_h", "u", "anchor", "off", F.inline("digests")).select(
        "doc_id", "_tl_h", (F.col("u") + F.col("i")).alias("first"), "anchor", (F.col("i") - F.col("off")).alias("at"), "digest"))
    string = ["anchor", "at", "digest"]
    twice = stored(each.groupBy(*string).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*string))
    return marks.unionAll(each.join(twice, string).select("doc_id", "_tl_h", "first", (F.col("first") + window).alias("past")))


def _remove(batch: pa.RecordBatch) -> pa.RecordBatch:
    spans, kept = [], []
    for text, marks in zip(batch.column("_tl_text").to_pylist(), batch.column("_tl_marks").to_pylist()):
        text = text or b""
        runs: list[list[int]] = []
        for m in sorted((m["first"], m["past"]) for m in marks or ()):
            if runs and m[0] <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], m[1])
            else:
                runs.append([*m])
        at, parts = 0, []
        for a, b in runs:
            parts.append(text[at:a])
            at = b
        parts.append(text[at:])
        spans.append([{"first": a, "past": b} for a, b in runs])
        kept.append(b"".join(parts))
    names = [n for n in batch.schema.names if n not in ("_tl_text", "_tl_marks")]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                      [*names, "removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, removed (spans of bytes: first, past) and kept (the other bytes).

    A byte goes if a string of ``window`` bytes over it also starts at another place, in this or another row; all
    strings are judged on the input, so no copy stays. A null text is empty; texts shorter than ``window`` lose nothing.
    Rows alike in doc_id and text are copies of each other. Other columns are ignored.
    """
    marks = repeated_marks(docs, window, gram, crowd).groupBy("doc_id", "_tl_h").agg(
        F.collect_set(F.struct("first", "past")).alias("_tl_marks"))  # bounded by the text's own length
    marks = marks.select(F.col("doc_id").alias("_tl_d"), F.col("_tl_h").alias("_tl_h2"), "_tl_marks")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_tl_h"), F.col("text").cast("binary").alias("_tl_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_tl_d")) & (F.col("_tl_h") == F.col("_tl_h2"))
    rows = rows.join(marks, same, "left").select("doc_id", F.coalesce(F.octet_length("_tl_text"), F.lit(0)).cast("long").alias("n_bytes"),
                                                 "_tl_text", "_tl_marks")
    schema = with_field(with_field(docs.select("doc_id").schema, "n_bytes", "long"), "removed", "array<struct<first:long,past:long>>")
    return map_batches(rows, _remove, with_field(schema, "kept", "binary"))
