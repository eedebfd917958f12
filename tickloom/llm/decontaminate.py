"""Benchmark decontamination by a broadcast set of normalised n-grams. DataFrame expressions only.

Each document gives its token windows, one row at a time and never a whole text's windows at once; they meet the benchmark's
windows in one join on the window text, so a hit is an equal window, not an equal hash. The benchmark side is broadcast only if its measured size is within ``BROADCAST_BYTES``;
beyond that Spark shuffles both sides. Every document also sends one marker row with its word count
through the same shuffle, so the table is read once and nothing is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

#: Words are runs of digits, letters and everything beyond ASCII; A-Z is lowered.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
N = 10
BROADCAST_BYTES = 64 << 20


def _windows(array: Column, span) -> Column:
    """Every run of ``span`` words with its start; none if there are fewer words."""
    last = F.size(array) - span
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        i.alias("at"), F.lit(span).cast("int").alias("span") if isinstance(span, int) else span.cast("int").alias("span"),
        F.array_join(F.slice(array, i + 1, span), " ").alias("window")))


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """window, span and the ids of the items that hold it. Items without words give none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("s", F.least(F.size("w"), F.lit(n)))
    rows = items.select("item", F.inline(_windows(F.col("w"), F.col("s"))))
    return rows.groupBy("window", "span").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted ids), hits (word spans: first, past the last).

    ``n`` words in a row make a window; an item of fewer is one window. Null and empty texts have no words and no
    hits, as have all texts if the benchmark is empty. Rows alike in doc_id and text are answered each. A hit of
    an item whose id is null counts as hit words but names no item. Other columns are ignored.
    """
    grams = benchmark_windows(benchmark, n)
    facts = grams.agg(F.sum(F.octet_length("window") + 64 + 24 * F.size("items")), F.collect_set("span")).first()
    spans = sorted(facts[1])
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    # place -1 is the document's marker
    places = rows.select("doc_id", "h", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("i"))
    each = places.select("doc_id", "h", "w", "i", F.explode(F.array(F.lit(0), *map(F.lit, spans))).alias("span"))
    each = each.filter(F.when(F.col("i") < 0, F.col("span") == 0).otherwise((F.col("span") > 0) & (F.col("i") + F.col("span") <= F.size("w"))))
    rows = each.select(
        "doc_id", "h", F.when(F.col("i") < 0, -1 - F.size("w")).otherwise(F.col("i")).alias("at"), "span",
        F.when(F.col("i") >= 0, F.array_join(F.slice("w", F.col("i") + 1, F.greatest(F.col("span"), F.lit(0))), " ")).alias("window"))
    small = (facts[0] or 0) <= BROADCAST_BYTES
    met = rows.join(F.broadcast(grams) if small else grams, ["window", "span"], "left")
    met = met.filter((F.col("at") < 0) | F.col("items").isNotNull())
    hit = F.col("items").isNotNull()
    order = Window.partitionBy("doc_id", "h").orderBy("at", "span").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(hit, F.col("at") + F.col("span"))).over(order)
    end = F.col("at") + F.col("span")
    met = met.withColumn("new", F.when(hit, F.greatest(F.lit(0), end - F.greatest("at", F.coalesce(before, F.lit(0))))))
    found = met.groupBy("doc_id", "h").agg(
        F.count(F.when(~hit, 1)).alias("copies"), F.max(-1 - F.col("at")).alias("n_words"),
        F.coalesce(F.sum("new"), F.lit(0)).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.collect_set(F.when(hit, F.struct(F.col("at").alias("first"), end.alias("past"))))).alias("hits"))
    # two identical rows sent their hits twice to one group: sums count once, as the second adds no new words
    return found.select("doc_id", F.greatest(F.col("n_words"), F.lit(0)).cast("long").alias("n_words"),
                        F.col("n_hit").cast("long").alias("n_hit"), "items", "hits",
                        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def without_spans(text: Column, hits: Column) -> Column:
    """``text`` without the hit words and what separates them from the word before."""
    found, gaps = F.regexp_extract_all(text, F.lit(ANY_CASE_WORD), F.lit(0)), F.split(text, ANY_CASE_WORD)
    gone = F.flatten(F.transform(hits, lambda h: F.sequence(h["first"], h["past"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(found)), gone)
    return F.when(F.size(hits) == 0, text).otherwise(
        F.array_join(F.transform(kept, lambda i: F.concat(F.get(gaps, i), F.coalesce(F.get(found, i), F.lit("")))), ""))


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of ``docs`` without those that hold a window of the benchmark; all columns kept."""
    leaked = contamination(docs, benchmark, n).filter("n_hit > 0").select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["_leaked"]), "left_anti")
