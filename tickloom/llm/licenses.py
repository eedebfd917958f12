"""License texts found by diagonal voting. DataFrame expressions only.

Every run of ``K`` words of a document is hashed and joined with the places where the templates hold that run. A match at
document word ``at`` and template word ``pos`` is a vote for the diagonal ``at - pos``, counted only if its words are
equal and not just their hashes. A diagonal is one shift of a template over the document: votes are gathered as bits
per diagonal, which aggregates before anything is shuffled and makes repeated rows harmless. A phrase stands where
its diagonal has every vote. A notice may have words added or lost, which moves the rest to a neighbouring diagonal: such
diagonals are merged, and the span is kept if enough of the template is in it and it is not stretched too far.

The templates are fixed values of a few kilobytes, so their join is a broadcast. One marker row per document
carries its word count through the same plan, so the table is read once and nothing is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import words

#: Words in a run; bits of votes kept in one number; most words between diagonals that are merged; least votes of such a
#: diagonal; least share of a notice's runs found; longest span, as a multiple of the notice.
K, BITS, GAP, VOTES, SHARE, STRETCH = 3, 60, 12, 2, 0.7, 2

# Phrases whose whole wording must stand, and notices that may differ a little.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
NOTICES = (
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
                 "license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met redistributions of source code must retain the above copyright notice this list of "
            "conditions and the following disclaimer"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
              "license as published by the free software foundation either version 3 of the license or at your option any later "
              "version"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def _templates(spark, phrases, notices, k: int) -> DataFrame:
    """One row per run of ``k`` words of each template: template, base, label, runs (how many it has), pos, gram, hash."""
    rows = []
    for template, (base, label, text) in enumerate([(True, *p) for p in phrases] + [(False, *n) for n in notices]):
        found = text.split()
        if len(found) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        rows += [(template, base, label, len(found) - k + 1, pos, " ".join(found[pos:pos + k]))
                 for pos in range(len(found) - k + 1)]
    made = spark.createDataFrame(rows, "template int, base boolean, label string, runs int, pos int, gram string")
    return made.withColumn("hash", F.xxhash64(*(F.split("gram", " ")[i] for i in range(k))))


def license_spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words and spans, an array of (first, past, label, base, share) in that order.

    ``first`` and ``past`` count words from 0; ``base`` marks a phrase, whose ``share`` is 1; every place of a phrase is
    a span of its own, overlapping ones too. ``share`` of a notice is the part of its runs of ``k`` words found in
    the span. Null and empty texts have no words and no spans. Rows alike in doc_id and text are answered each; a null
    doc_id is an id like any other. No rows give no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    places = rows.select("doc_id", "h", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.size("w") - k))).alias("at"))
    run = [F.get("w", F.col("at") + i) for i in range(k)]
    keyed = places.select("doc_id", "h", "w", "at", F.when(F.col("at") >= 0, F.xxhash64(*run)).alias("hash"))
    templates = _templates(docs.sparkSession, phrases, notices, k)
    met = keyed.join(F.broadcast(templates), "hash", "left")
    met = met.filter((F.col("at") < 0) | (F.col("gram") == F.concat_ws(" ", *run)))
    votes = met.select(
        "doc_id", "h", "template", "base", "label", "runs", "at", F.when(F.col("at") < 0, F.size("w")).alias("n_words"),
        (F.col("at") - F.col("pos")).alias("diagonal"), F.floor(F.col("pos") / BITS).alias("block"),
        F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % BITS)).alias("bit"))
    # a row of a document's own (no template) is its marker; the others are votes
    votes = votes.groupBy("doc_id", "h", "template", "base", "label", "runs", "diagonal", "block").agg(
        F.bit_or("bit").alias("bits"), F.min("at").alias("first"), (F.max("at") + k).alias("past"),
        F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"))
    whole = Window.partitionBy("doc_id", "h", "template", "diagonal")
    votes = votes.withColumn("votes", F.sum(F.bit_count("bits")).over(whole))
    votes = votes.filter(F.col("template").isNull() | F.when(F.col("base"), F.col("votes") == F.col("runs"))
                         .otherwise(F.col("votes") >= F.least(F.lit(VOTES), F.col("runs"))))
    order = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal", "block")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("base"), 0).otherwise(GAP), F.lit(False))
    votes = votes.withColumn("apart", apart.cast("int"))
    votes = votes.withColumn("place", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = votes.groupBy("doc_id", "h", "template", "base", "label", "runs", "place", "block").agg(
        F.bit_or("bits").alias("bits"), F.min("first").alias("first"), F.max("past").alias("past"),
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"))
    spans = blocks.groupBy("doc_id", "h", "template", "base", "label", "runs", "place").agg(
        (F.sum(F.bit_count("bits")) / F.col("runs")).alias("share"), F.min("first").alias("first"), F.max("past").alias("past"),
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"))
    kept = F.col("base") | ((F.col("share") >= SHARE) & (F.col("past") - F.col("first") <= STRETCH * (F.col("runs") + k - 1)))
    span = F.when(kept, F.struct("first", "past", "label", "base", "share"))
    found = spans.groupBy("doc_id", "h").agg(
        F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_list(span)).alias("spans"),
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"))
    return found.select("doc_id", "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")) \
        .drop("_copy")
