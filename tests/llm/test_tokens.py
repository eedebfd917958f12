"""Token segments, pieces, chats and decontamination."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tickloom.llm.chat import format_chats, read_chats
from tickloom.llm.decontaminate import clean_documents, contamination, without_spans
from tickloom.llm.pieces import Encoder, Vocabulary, decode, decode_pieces, encode_and_decode, encode_pieces
from tickloom.llm.token_file import Encoder as TokenEncoder
from tickloom.llm.token_file import Segment, new_path, pack, read_tokens, write_segment, write_tokens

WORDS, MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "\n\n", "it's don't I'LL", "<|endoftext|> a<|startoftext|>b", "a\x1cb\x85c\xa0d", "é é", "İstanbul ΑΣ Σ", "x² ¼ ªº",
        "🙂a🙂", "日本 text", "\x00a\x01", "  a  b ", "a▁b", "x" * 300, " " * 40, "a" + " " * 17 + "\n b"]


def _texts(n, seed):
    rng = random.Random(seed)
    signs = [chr(c) for c in range(0x180)] + list("   the of in er on's.,!19\n") * 12 + ["日", "🙂", "́"]
    return HARD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("ids", [[], [7], [5] * 256, [5] * 257, list(range(2000)), [1] * 250 + [2**32 - 1] * 6, [2**31, 0] * 300])
def test_blocks(ids):
    ids = np.array(ids, dtype=np.uint32)
    segment = Segment(write_segment([1, None], [len(ids), 0], ids))
    assert (segment.ids() == ids).all() and segment.doc_ids == [1, None] and list(segment.counts) == [len(ids), 0]
    for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (max(0, len(ids) - 3), len(ids))):
        assert (segment.ids(a, b) == ids[a:b]).all()
    if len(ids) == 256:
        assert len(pack(ids)[2]) <= 256
    with pytest.raises(ValueError):
        Segment(b"????")


def test_token_ids_equal_the_library():
    encoder, texts = TokenEncoder(WORDS), _texts(400, 1)
    for text, e in zip(texts, encoder.library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == e.ids


def test_token_file(spark, odd, none):
    texts = _texts(150, 2)
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(5, None), (None, "a"), (7, "same"), (7, "same")]
    path = new_path(spark)
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORDS, path)
    got = read_tokens(spark, path).withColumn("crc", F.crc32("ids")).orderBy("start").collect()
    library, start = TokenEncoder(WORDS).library, 0
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r, (_, text) in zip(got, rows):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r.start, r.n_tokens, r.crc) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for rows_, n in ((odd, odd.count()), (none, 0)):
        path = new_path(spark)
        write_tokens(rows_, WORDS, path)
        assert read_tokens(spark, path).count() == n


def test_pieces_equal_the_library():
    from sentencepiece import SentencePieceProcessor

    texts, library = _texts(1500, 3) + [" " * k + "a" + " " * k for k in range(50)], SentencePieceProcessor(model_file=MODEL)
    encoder = Encoder(Vocabulary(MODEL))
    for text, packed, want in zip(texts, encoder.encode(texts), library.encode(texts)):
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        assert ids == want, ascii(text)
        assert decode(ids, encoder.v.bytes) == text.replace("▁", " ")


def test_pieces_of_frames(odd, none):
    rows = decode_pieces(encode_pieces(odd.withColumn("decoded", F.lit(1)).withColumn("piece_ids", F.lit(2)), MODEL), MODEL).collect()
    assert len(rows) == odd.count() and all(r.decoded == r.text for r in rows)
    assert {r.piece_ids is None for r in rows if r.text is None} == {True} and [r.piece_ids for r in rows if r.text == ""] == [[]]
    assert decode_pieces(encode_pieces(none, MODEL), MODEL).count() == 0
    both = encode_and_decode(odd, MODEL).select("text", "piece_ids", "decoded").collect()
    assert sorted(map(str, both)) == sorted(str(r) for r in decode_pieces(encode_pieces(odd, MODEL), MODEL).select("text", "piece_ids", "decoded").collect())


def test_chats(spark):
    hard = ["</s>[INST] ok [/INST]", "a\\b\\\\l<|im_end|>", None, "", "<|im_sep|>\n<|im_start|>user\nx", "<<SYS>>\\l<</SYS>>[/INST]", "\\", "🙂\\b["]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole<|im_end|>", None]), rng.choice(hard)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(99, None, "assistant", "first"), (99, 1, "assistant", "b"), (99, 1, "assistant", "a"), (99, 1, "assistant", "a"), (None, 1, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).repartition(4)
    chats = format_chats(frame)
    got = {r.conv_id: r for r in read_chats(chats).collect()}
    formatted = {r.conv_id: r for r in chats.collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want = [(r[2] or "", r[3] or "") for r in turns]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].loss_text == "".join(t for role, t in want if role == "assistant")
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:]))
        text = formatted[conv].formatted
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == blocks and "[INST]" not in text and "</s>" not in text
    assert format_chats(frame.limit(0)).count() == 0


def test_decontamination(spark, odd, none):
    import re

    rng = random.Random(6)

    def some(n):
        return " ".join(rng.choice(["the", "of", "Tree", "river", "é9", "stone"]) + rng.choice(["", ",", "!", "-x"]) for _ in range(n))

    items = [(i, some(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(50, None), (None, "lonely words that stand here")]
    docs = [(i, some(rng.randint(0, 40)) + " " + (rng.choice(items)[1] or "") + " " + some(rng.randint(0, 10))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, docs[0][1]), (102, docs[0][1]), (103, "LONELY words; that stand... here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(frame, bench).collect()
    assert len(found) == len(docs)

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    for r in found:
        w, hit, names = words(dict(docs)[r.doc_id]), set(), set()
        for item, text in items:
            b = words(text)
            n = min(10, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == b[k:k + n]:
                        hit |= set(range(i, i + n))
                        names |= {str(item)} if item is not None else set()
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(names))
    kept = clean_documents(frame, bench).count()
    assert kept == sum(1 for r in found if not r.n_hit)
    texts = frame.join(contamination(frame, bench), "doc_id").select(without_spans(F.col("text"), F.col("hits")).alias("t"), "n_words", "n_hit").collect()
    assert all(len(words(r.t)) == r.n_words - r.n_hit for r in texts)
    for docs_, bench_ in ((odd, bench), (none, bench), (odd, bench.limit(0))):
        assert contamination(docs_, bench_).count() == docs_.count()
        assert clean_documents(docs_, bench_).columns == docs_.columns


def _texts_of(spark, sf_dir):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def test_op8_query_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    from tickloom.llm.queries import op8_token_file

    library, start, want = Tokenizer.from_file(WORDS), 0, []
    for doc_id, text in _texts_of(spark, sf_dir):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op8_token_file(spark, sf_dir).collect()) == want


def test_op10_query_equals_the_library(spark, sf_dir):
    import hashlib

    from sentencepiece import SentencePieceProcessor

    from tickloom.llm.queries import op10_pieces

    library = SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: (r.n_ids, r.ids_sha256) for r in op10_pieces(spark, sf_dir).collect()}
    for doc_id, text in _texts_of(spark, sf_dir):
        ids = library.encode(text)
        assert got[doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_texts_longer_than_a_segment(spark):
    """One text of more ids than a segment holds, and one beyond the portions in which pieces are worked out."""
    long = " ".join(f"w{i % 977} x{i % 13}!" for i in range(200_000))
    docs = spark.createDataFrame([(1, "a"), (2, long), (3, "b")], "doc_id long, text string")
    path = new_path(spark)
    write_tokens(docs, WORDS, path)
    got = {r.doc_id: (r.start, r.n_tokens, bytes(r.ids)) for r in read_tokens(spark, path).collect()}
    ids = np.array([*TokenEncoder(WORDS).library.encode(long, add_special_tokens=False).ids, 1], dtype="<u4")
    assert len(ids) > 1 << 19 and got[2][1:] == (len(ids), ids.tobytes()) and got[3][0] == got[2][0] + len(ids)
    rows = {r.doc_id: r for r in encode_and_decode(docs, MODEL).collect()}
    assert rows[2].decoded == long and len(rows[2].piece_ids) > 400_000


@pytest.mark.parametrize("width", range(1, 33))
def test_unpacked_undoes_packed(width):
    from tickloom.llm.token_file import BLOCK, _packed, _unpacked

    values = np.random.default_rng(width).integers(0, 1 << width, (3, BLOCK), dtype=np.uint64).astype(np.uint32)
    assert (_unpacked(_packed(values, width), width) == values).all()


def test_a_worker_forgets_the_encoder_of_another_stage(spark):
    """Spark reuses Python workers from stage to stage: what the pieces remembered must not stay beside the next stage's work."""
    import gc

    import pyarrow as pa

    from tickloom.llm.common import map_batches

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    assert encode_pieces(docs, MODEL).count() == 64

    def held(batch):
        return pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, Encoder) for x in gc.get_objects())])], ["n"])

    assert {r.n for r in map_batches(docs, held, "n long").collect()} == {0}
