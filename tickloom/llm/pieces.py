"""SentencePiece encoding and decoding by suffix-array matching.

A text is cut before every space sign; no piece of the vocabulary reaches over such a cut. The stretches that a batch
brings anew are laid in one string whose suffix array is built to the depth of the longest piece. Every piece of the
vocabulary is searched in it by bisection, all pieces at once, one character further each time; its range gives its
occurrences, which are the edges of the batch. Sorted by where they end, edges are relaxed from left to right.

The model merges pairs by score, so an edge wins not by a sum but by agreement: the encoding of a prefix ends in the one
piece that the merges would leave standing next to the last piece of what is before it. Whether two pieces stay
apart is answered from the tree of merges of each (``compatible``), and remembered.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_stage, map_batches, with_field

SPACE = "▁"
NEVER = np.iinfo(np.int64).max
MEMO, CHARS, NEW_CHARS, PAIRS = 350_000, 2_000_000, 250_000, 1 << 20


def merged(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """What is left of ``text`` after merging neighbours by score, leftmost first; and the two halves of the last merge."""
    part: list[str | None] = list(text)
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else len(part)
        if j < len(part) and (both := part[i] + part[j]) in score:
            heapq.heappush(heap, (-score[both], i, both))

    for i in range(len(part)):
        offer(i)
    last = None
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j >= len(part) or part[i] + part[j] != both:
            continue
        last = part[i], part[j]
        part[i], part[j], after[i] = both, None, after[j]
        if after[j] < len(part):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in part if p is not None], last


class Vocabulary:
    """Tables of a model, built once on the driver and sent to the tasks. Bounded by the vocabulary's size."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(len(model))]
        usual = [i for i in range(len(model))
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {names[i]: model.get_score(i) for i in usual}
        self.id = {names[i]: i for i in usual}
        self.byte = [next((i for i in range(len(model)) if names[i] == f"<0x{b:02X}>"), model.unk_id()) for b in range(256)]
        self.bytes = [b""] * len(model)
        for i in usual:
            self.bytes[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            if i != model.unk_id():
                self.bytes[i] = bytes([b])
        if any(SPACE in n.lstrip(SPACE) or (n.startswith(SPACE * 2) and n.strip(SPACE)) for n in self.score):
            raise ValueError("a piece of this model reaches over a space")

        n = len(model) + 1  # the last stands for a character that the vocabulary lacks
        self.unknown = n - 1
        self.rank, self.left, self.right = np.full(n, -1, dtype=np.int64), np.arange(n), np.arange(n)
        self.runs = {name: s for name, s in self.score.items() if not name.strip(SPACE)}
        words = {name: s for name, s in self.score.items() if name.strip(SPACE) or name == SPACE}
        order = {s: k for k, s in enumerate(sorted({-s for s in words.values()}))}
        self.pieces: list[tuple[str, int]] = []
        for name, s in words.items():
            left, halves = merged(name, words) if len(name) > 1 else ([name], None)
            if len(left) > 1 or (halves and not (halves[0] in words and halves[1] in words)):
                continue  # its own merges never make it
            i = self.id[name]
            self.pieces.append((name, i))
            if halves:
                self.rank[i], self.left[i], self.right[i] = order[-s], self.id[halves[0]], self.id[halves[1]]
        self.pieces.sort()
        pairs = sorted((self.id[name[:k]] * n + self.id[name[k:]], self.rank[self.id[name]])
                       for name, _ in self.pieces for k in range(1, len(name))
                       if name[:k] in words and name[k:] in words)
        self.pair = np.array([p for p, _ in pairs] + [NEVER], dtype=np.int64)
        self.pair_rank = np.array([r for _, r in pairs] + [NEVER], dtype=np.int64)
        self.n = n

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of piece a followed by that of b leaves exactly these two.

        The two trees of merges are taken apart from the last merge back. A pair that touches across the border while both
        stand would be merged if its rank comes before the merges that use up its left and its right part.
        """
        ok, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        use_a, use_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            key = a * self.n + b
            at = np.searchsorted(self.pair, key)
            rank = np.where(self.pair[at] == key, self.pair_rank[at], NEVER)
            joins = (rank < use_a) & (rank <= use_b) & (rank < NEVER)
            ok[live[joins]] = False
            ra, rb = self.rank[a], self.rank[b]
            undo_a = ra > rb
            go = ~joins & ((ra >= 0) | (rb >= 0))
            use_a, use_b = np.where(undo_a, ra, use_a)[go], np.where(undo_a, use_b, rb)[go]
            a, b, live = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go], live[go]
        return ok


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``codes`` (1 and up) by their first ``depth`` codes, by doubling what is compared."""
    n = len(codes)
    rank, done = codes.astype(np.int64), 1
    width = int(rank.max(initial=1)) + 1
    while width < 1 << 15 and done < depth:  # widen by whole numbers while they fit
        shifted = np.zeros(n, dtype=np.int64)
        shifted[:max(0, n - done)] = rank[done:]
        rank, width, done = rank * width + shifted, width * width, done * 2
    while True:
        order = np.argsort(rank)  # suffixes alike so far may come in any order
        if done >= depth:
            return order
        rank_of, sorted_ = np.empty(n, dtype=np.int64), rank[order]
        rank_of[order] = np.cumsum(np.append(1, sorted_[1:] != sorted_[:-1]))
        shifted = np.zeros(n, dtype=np.int64)
        shifted[:max(0, n - done)] = rank_of[done:]
        rank, done = rank_of * (n + 1) + shifted, done * 2


class Encoder(dict):
    """Ids (packed uint32) of '▁' + stretch, for stretches without spaces. When full, what was remembered is put aside, and
    what is asked for again comes back from there."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = v = vocabulary
        alphabet = sorted({c for name, _ in v.pieces for c in name})
        self.code = {c: k + 2 for k, c in enumerate(alphabet)}  # 1: any other character
        self.depth = max(len(name) for name, _ in v.pieces)
        self.length = np.array([len(name) for name, _ in v.pieces])
        self.ids = np.array([i for _, i in v.pieces])
        self.letters = np.zeros((len(v.pieces), self.depth), dtype=np.int64)
        for k, (name, _) in enumerate(v.pieces):
            self.letters[k, :len(name)] = [self.code[c] for c in name]
        points = np.array([ord(c) for c in alphabet])
        self.points, self.point_code = points, np.arange(2, len(points) + 2)
        self.size = np.ones(v.n, dtype=np.int64)
        self.size[self.ids] = self.length
        self.known = np.full(PAIRS, -1, dtype=np.int64)
        self.answer = np.zeros(PAIRS, dtype=bool)
        self.blank: dict[int, bytes] = {}
        self.aside: dict[str, bytes] = {}

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a * self.v.n + b
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64) & (PAIRS - 1)
        out = self.answer[slot]
        new = np.flatnonzero(self.known[slot] != pair)
        if len(new):
            some, back = np.unique(pair[new], return_inverse=True)
            found = self.v.compatible(some // self.v.n, some % self.v.n)
            out[new] = found[back]
            self.known[slot[new]], self.answer[slot[new]] = pair[new], out[new]
        return out

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of a piece in the text."""
        order = suffix_array(codes, self.depth)
        padded = np.concatenate([codes, np.zeros(self.depth, dtype=codes.dtype)])
        piece = np.arange(len(self.ids))
        low, high = np.zeros(len(piece), dtype=np.int64), np.full(len(piece), len(codes), dtype=np.int64)
        starts, found = [], []
        for d in range(self.depth):
            column = padded[order + d]  # sorted inside any range of suffixes alike in d characters
            want = self.letters[piece, d]
            low = self._bisect(column, low, high, want)
            high = self._bisect(column, low, high, want + 1)
            some = low < high
            piece, low, high = piece[some], low[some], high[some]
            whole = self.length[piece] == d + 1
            count = high[whole] - low[whole]
            if count.sum():
                first = np.repeat(low[whole] - (np.cumsum(count) - count), count)
                starts.append(order[first + np.arange(count.sum())])
                found.append(np.repeat(piece[whole], count))
            piece, low, high = piece[~whole], low[~whole], high[~whole]
            if not len(piece):
                break
        if not starts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(starts), np.concatenate(found)

    @staticmethod
    def _bisect(column: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) >> 1
            less = column[mid] < want[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)

    def learn(self, stretches: list[str]) -> None:
        text = SPACE + SPACE.join(stretches)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        codes = np.where(self.points[at] == points, self.point_code[at], 1)
        size = np.array([len(s) + 1 for s in stretches])
        past = np.cumsum(size)
        first = past - size
        start, piece = self._edges(codes)
        token = self.ids[piece]
        lacking = np.flatnonzero(codes == 1)
        start, token = np.concatenate([start, lacking]), np.concatenate([token, np.full(len(lacking), self.v.unknown)])
        end = start + self.size[token]
        offset = np.arange(len(codes)) - np.repeat(first, size)
        step = offset[end - 1]
        longest = int(size.max())
        by_end = np.argsort(step.astype(np.int16) if longest < 1 << 15 else step, kind="stable")
        start, token, end = start[by_end], token[by_end], end[by_end]
        bound = np.searchsorted(step[by_end], np.arange(longest + 1))
        last = np.full(len(codes) + 1, -1, dtype=np.int64)  # piece that ends the encoding of the prefix
        opening = np.zeros(len(codes) + 1, dtype=bool)
        opening[first] = True
        for a, b in zip(bound[:-1], bound[1:]):
            s, t = start[a:b], token[a:b]
            fits = opening[s]
            rest = np.flatnonzero(~fits)
            fits[rest] = self._agree(last[s[rest] - 1], t[rest])
            last[end[a:b][fits] - 1] = t[fits]
        taken, owner, where = [], np.arange(len(stretches)), past.copy()
        while len(owner):
            t = last[where - 1]
            taken.append((owner, t))
            where = where - self.size[t]
            more = where > first[owner]
            owner, where = owner[more], where[more]
        # a stretch's pieces were found from its end, one in each round: its k-th round is the k-th place from behind
        count = np.zeros(len(stretches), dtype=np.int64)
        for owner, _ in taken:
            count[owner] += 1
        past = np.cumsum(count)
        at = past - count
        tokens = np.empty(int(count.sum()), dtype="<u4")
        for k, (owner, t) in enumerate(taken):
            tokens[past[owner] - 1 - k] = t
        data = tokens.tobytes()
        for s, i, c in zip(stretches, at.tolist(), count.tolist()):
            self[s] = data[4 * i:4 * (i + c)]
        for k in np.unique(np.searchsorted(past, np.flatnonzero(tokens == self.v.unknown), "right")):  # characters outside the vocabulary go as bytes
            row, rest, out = tokens[at[k]:at[k] + count[k]], SPACE + stretches[k], []
            for t in row.tolist():
                n = int(self.size[t])
                out += [self.v.byte[b] for b in rest[:n].encode("utf-8", "replace")] if t == self.v.unknown else [t]
                rest = rest[n:]
            self[stretches[k]] = np.array(out, dtype="<u4").tobytes()

    def _blanks(self, n: int) -> bytes:
        """Ids of n space signs in a row."""
        if n not in self.blank:
            parts, _ = merged(SPACE * n, self.v.runs)
            value = np.array([self.v.id[p] for p in parts], dtype="<u4").tobytes()
            if len(self.blank) >= MEMO:
                self.blank.clear()
            self.blank[n] = value
        return self.blank[n]

    def _join(self, parts: list[str]) -> bytes:
        if "" not in parts:
            return b"".join(map(self.__getitem__, parts))
        out, blanks, alone = [], 0, np.array([self.v.id[SPACE]], dtype="<u4").tobytes()
        for p in parts:
            if not p:
                blanks += 1
                continue
            ids = self[p]
            if blanks and ids[:4] == alone:  # the space stays single before this stretch, so it joins those before it
                ids, blanks = ids[4:], blanks + 1
            out.append(self._blanks(blanks) if blanks else b"")
            out.append(ids)
            blanks = 0
        out.append(self._blanks(blanks) if blanks else b"")
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, in portions of bounded size."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            parts, chars = [], 0
            while at < len(texts) and (not parts or chars + len(texts[at]) <= CHARS):
                chars += len(texts[at])
                parts.append(texts[at].replace(SPACE, " ").split(" ") if texts[at] else [])
                at += 1
            if len(self) >= MEMO:
                self.aside = dict(self)
                self.clear()
            held, size = [], 0
            for s in set().union(*parts).difference(self):
                if (value := self.aside.get(s)) is not None:
                    self[s] = value
                elif s:
                    held.append(s)
                    size += len(s) + 1
                    if size >= NEW_CHARS:
                        self.learn(held)
                        held, size = [], 0
            if held:
                self.learn(held)
            out += map(self._join, parts)
        return out


def _encoder(model: str) -> Encoder:
    return Encoder(Vocabulary(model))


def encoder_for(model: str) -> Encoder:
    """The worker's encoder: what it remembers serves the next task too, and goes when the worker turns to another stage."""
    return kept_in_stage(_encoder, model)


def decode(ids: list[int], pieces: list[bytes]) -> str:
    text = b"".join(map(pieces.__getitem__, ids))
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), values], [*kept, name])


def _encoded(batch: pa.RecordBatch, model: str) -> pa.RecordBatch:
    column = batch.column("text")
    packed = encoder_for(model).encode([t or "" for t in column.to_pylist()])
    size = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    ids = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"), pa.int32())
    mask = column.is_null() if column.null_count else None
    return _with(batch, "piece_ids", pa.ListArray.from_arrays(pa.array(offsets), ids, mask=mask))


def _decoded(batch: pa.RecordBatch, model: str) -> pa.RecordBatch:
    column, pieces = batch.column("piece_ids"), encoder_for(model).v.bytes
    at, ids = column.offsets.to_numpy(), column.values.to_numpy()  # offsets of a slice still count from the whole
    texts = [decode(ids[a:b].tolist(), pieces) if ok else None  # one text's ids at a time become Python numbers
             for a, b, ok in zip(at[:-1], at[1:], column.is_valid().to_pylist())]
    return _with(batch, "decoded", pa.array(texts, pa.string()))


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` (any columns) with ``piece_ids`` added or replaced: the ids that the model gives the whole text.

    A null text has null ids, an empty one no ids. Equal texts have equal ids. ``model`` is the model file's place, the
    same on every machine.
    """
    docs = docs.drop("piece_ids")
    return map_batches(docs, lambda b: _encoded(b, model), with_field(docs.schema, "piece_ids", "array<int>"))


def decode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with ``decoded`` added or replaced: the text that ``piece_ids`` stand for; null where they are null."""
    docs = docs.drop("decoded")
    return map_batches(docs, lambda b: _decoded(b, model), with_field(docs.schema, "decoded", "string"))


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """``decode_pieces(encode_pieces(docs))`` in one pass, so a task needs one Python worker and not two."""
    docs = docs.drop("piece_ids", "decoded")
    schema = with_field(with_field(docs.schema, "piece_ids", "array<int>"), "decoded", "string")
    return map_batches(docs, lambda b: _decoded(_encoded(b, model), model), schema)
