"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, read_chats
from .common import table
from .decontaminate import contamination
from .lexical import rank_documents
from .licenses import license_spans
from .line_dedup import dedup_lines
from .phrases import collocations
from .pieces import SPACE, encode_and_decode
from .pivots import near_vectors
from .quality import quality
from .oracles import ORACLES
from .simhash import near_duplicates
from .substrings import remove_repeats
from .token_file import new_path, read_tokens, write_tokens
from .toxicity import toxicity


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _fold(5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"),
                         (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                       F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _fold(4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality(docs, table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                        (F.size("removed") > 0).alias("repeats"))


def op7_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    read = read_chats(format_chats(rows.unionByName(hard)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return rows.select("doc_id", F.size("piece_ids").cast("long").alias("n_ids"),
                       F.sha2(F.array_join(F.transform("piece_ids", lambda i: i.cast("string")), ","), 256).alias("ids_sha256"),
                       (F.col("decoded") == F.replace("text", F.lit(SPACE), F.lit(" "))).alias("round_trip"))


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    starts = F.transform(base, lambda s: s["first"].cast("long"))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def llm_queries() -> dict:
    return {f.__name__: f for f in (
        op1_toxicity, op2_line_dedup, op3_quality, op4_simhash, op5_decontaminate, op6_substrings, op7_pivots, op8_token_file, op9_chat,
        op10_pieces, op11_dual_tree, op12_licenses, op13_phrases)}


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
