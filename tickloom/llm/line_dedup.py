"""Removal of repeated runs of lines by prefix doubling over line-id sequences. DataFrame expressions only.

A document is the sequence of the ids of its lines that are not blank. Doubling names the first 2, 4, 8 ... lines of every
suffix from the names of its two halves, up to ``min_lines``: there, suffixes of one name are one interval of
the suffix array whose longest common prefix is at least ``min_lines``. Deeper rounds would order suffixes inside
an interval but cannot change its members, so they are not run. The intervals are found by one shuffle on the name
that aggregates before it moves rows. In an interval every suffix but the first, by doc_id and line, starts a
later copy; lines covered by later copies go, and neighbouring ones make up the maximal repeated runs.

With ``long_words`` a line of at least so many words is a run by itself: such lines have a name of one line beside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_LINES = 2
ADDED = ("n_lines", "n_removed", "n_runs")


def _name(*parts: Column) -> Column:
    """A name of 128 bits: two hashes of the same parts, each of its own seed."""
    return F.struct(F.xxhash64(*(p["a"] for p in parts)).alias("a"), F.xxhash64(F.lit(1), *(p["b"] for p in parts)).alias("b"))


def _line_name(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _names(ids: Column, n: int) -> Column:
    """Name of the first ``n`` items of each suffix that is long enough."""
    names, depth = ids, 1

    def paired(left: Column, shift: int) -> Column:
        count = F.greatest(F.lit(0), F.size(left) - shift)
        return F.zip_with(F.slice(left, F.lit(1), count), F.slice(left, F.lit(1 + shift), count),
                          lambda a, b: _name(a, b))

    while depth * 2 <= n:
        names, depth = paired(names, depth), depth * 2
    return names if depth == n else paired(names, n - depth)


def _long(line: Column, words: int) -> Column:
    few = F.length(line) < 2 * words - 1  # spares the split
    return F.when(few, False).otherwise(F.size(F.filter(F.split(line, "\\s+"), lambda w: w != "")) >= words)


def repeated_windows(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """doc_id, _tl_h (hash of the text) and first, last line of every run of ``min_lines`` lines, or of one line of
    ``long_words`` words, that a former place holds."""
    lines = F.split("text", "\n")
    # a line is blank if only spaces, tabs and carriage returns are in it; blank lines belong to the line before them
    marked = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                      lambda s: F.translate(s["x"], " \t\r", "") != "")
    items = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("_tl_h"), F.size(lines).alias("n"),
                                                   marked.alias("m"))
    items = items.filter(F.size("m") >= (min_lines if long_words is None else 1)).select(
        "doc_id", "_tl_h", "n", F.transform("m", lambda s: s["i"]).alias("at"),
        F.transform("m", lambda s: _line_name(s["x"])).alias("ids"), *([] if long_words is None else [
            F.filter(F.transform("m", lambda s, p: F.when(_long(s["x"], long_words), p)), lambda p: p.isNotNull()).alias("long")]))
    rows = items.select("doc_id", "_tl_h", "n", "at", F.posexplode(_names(F.col("ids"), min_lines)).alias("p", "name"))
    rows = rows.withColumn("size", F.lit(min_lines))
    if long_words is not None:
        ones = items.select("doc_id", "_tl_h", "n", "at", F.explode("long").alias("p"), "ids")
        rows = rows.unionByName(ones.withColumn("name", F.get("ids", "p")).withColumn("name", _name(F.col("name"))).drop("ids").withColumn("size", F.lit(1)))
    past = F.coalesce(F.get("at", F.col("p") + F.col("size")), F.col("n"))
    windows = stored(rows.select("doc_id", "_tl_h", F.get("at", "p").alias("first"), (past - 1).alias("last"), "name.a", "name.b"))
    place = F.struct(F.col("doc_id").alias("d"), F.col("_tl_h").alias("h"), F.col("first").alias("f"))
    intervals = stored(windows.groupBy("a", "b").agg(F.min(place).alias("start"), F.count(F.lit(1)).alias("n"))
                       .filter("n > 1").select("a", "b", "start"))
    later = windows.join(intervals, ["a", "b"]).filter(~place.eqNullSafe(F.col("start")))
    return later.select("doc_id", "_tl_h", "first", "last")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """``docs`` with later copies of repeated runs taken out of ``text``; adds or replaces n_lines, n_removed, n_runs.

    All rows and columns stay; a document whose every line is a later copy keeps an empty text. Null texts stay null
    with no lines. Rows alike in doc_id and text are one place, so none is a copy of the other. Documents shorter than
    ``min_lines`` lines are never touched, unless ``long_words`` is given. A run that overlaps itself keeps its first lines.
    """
    span = F.collect_set(F.struct("first", "last"))
    cuts = repeated_windows(docs, min_lines, long_words).groupBy("doc_id", "_tl_h").agg(F.array_sort(span).alias("_tl_cuts"))
    cuts = cuts.select(F.col("doc_id").alias("_tl_d"), F.col("_tl_h").alias("_tl_h2"), F.array_distinct(F.flatten(F.transform(
        "_tl_cuts", lambda c: F.sequence(c["first"], c["last"])))).alias("_tl_gone"))
    rows = docs.withColumn("_tl_h", F.xxhash64("text"))
    rows = rows.join(cuts, F.col("doc_id").eqNullSafe(F.col("_tl_d")) & (F.col("_tl_h") == F.col("_tl_h2")), "left")
    lines = F.split("text", "\n")
    gone = F.coalesce("_tl_gone", F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col("_tl_gone").isNull(), F.col("text")) \
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    runs = F.size(F.array_except(gone, F.transform(gone, lambda i: i + 1)))
    return rows.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ADDED),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.size(gone).alias("n_removed"),
        runs.alias("n_runs"))
