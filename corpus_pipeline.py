"""A training corpus from raw documents: five stages, each the whole work of one operator on what the former kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last adds its own. A stage reads
its ``docs`` more than once, so between stages they are written as Parquet and read again.

In every stage an empty table gives an empty one, and columns beside doc_id, text and n_chars pass through untouched, whatever
their names. What a stage makes of null and empty texts, null and repeated ids is said in its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stored, table
from tickloom.llm.decontaminate import clean_documents
from tickloom.llm.line_dedup import dedup_lines
from tickloom.llm.near_copies import near_copies
from tickloom.llm.pieces import SPACE, encode_and_decode
from tickloom.llm.toxicity import toxicity


#: A repeated line of so many words goes even if the lines around it differ.
LONG_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the fit leaves out labels of the held-out fifth.

    Each row is judged by its own text, so rows that repeat an id may part. Null and empty texts score as the counted share
    of toxic labels says, and stay unless most labels are toxic.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return scored.filter("toxic_score < 0.5").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later copies of runs of lines and of long lines; n_chars follows the text.

    All rows stay: null and empty texts as they are, a document of nothing but later copies with an empty text. Rows alike in
    doc_id and text are one place. Null ids come first.
    """
    kept = dedup_lines(docs, long_words=LONG_WORDS)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        kept = kept.withColumn("n_chars", F.coalesce(changed, "n_chars"))
    return kept.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity the one with the smallest doc_id.

    Texts without words are one group. An id names its rows: all rows of an id go if one of them is a copy of a smaller id's,
    and rows that repeat the smallest id all stay. Rows without an id are never dropped.
    """
    gone = near_copies(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(stored(gone), F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark.

    All rows of an id go if one of them holds a window, rows without an id together likewise. Texts without words stay.
    """
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece_ids, and whether these decode to the text again.

    All rows stay. A null text has null ids and no answer; an empty one has no ids.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = encode_and_decode(docs, model)
    again = F.col("decoded") == F.replace("text", F.lit(SPACE), F.lit(" "))
    return rows.withColumn("round_trip", again).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark), ("pieces", to_pieces),
]

#: SQL cannot express the fitted classifier, the fingerprints or the piece encoding; the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stored(docs), sf_dir)
    return docs
