"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted. Adjacent turns of one role share one marked block, their texts
parted by ``PART``, so the block can be taken apart again. Control strings inside a text are escaped: ``\\`` is doubled, and
the first sign of a control string becomes ``\\l`` for ``<`` or ``\\b`` for ``[``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PART, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNT_ROLE = "assistant"
_ANGLE = r"<(?=\||/?s>|<?/?SYS>>|/?s\b)"
_SQUARE = r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, F.lit(_ANGLE), F.lit(r"\\l"))
    return F.regexp_replace(text, F.lit(_SQUARE), F.lit(r"\\b"))


def unescape(text: Column) -> Column:
    """Undo ``escape``: pairs of ``\\`` are found from the left, and only between them can a single one mark a sign."""
    def signs(piece: Column) -> Column:
        piece = F.replace(piece, F.lit("\\l"), F.lit("<"))
        piece = F.replace(piece, F.lit("\\b"), F.lit("["))
        return F.replace(piece, F.lit("\\n"), F.lit("\n"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), signs), "\\")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conv_id: formatted text, and the loss mask as spans (start, chars) of assistant text.

    ``rows`` has conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, then role, then text,
    nulls first. A null role or text is empty. Rows of a null conv_id form one conversation. Repeated rows are turns
    of their own. No rows give no rows. A conversation is one row of the result, so it must fit one task.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def part(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get("turns", i - 1)["role"] == t["role"])
        opening = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), _role(t["role"]), F.lit("\n"))
        return F.struct(F.when(same, F.lit(PART)).otherwise(opening).alias("lead"), escape(t["text"]).alias("body"),
                        (t["role"] == LEARNT_ROLE).alias("learn"))

    talks = talks.select("conv_id", F.transform("turns", part).alias("parts"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))

    def onward(done: Column, p: Column) -> Column:
        start = done["at"] + F.length(p["lead"])
        span = F.struct(start.alias("start"), F.length(p["body"]).alias("chars"))
        return F.struct((start + F.length(p["body"])).alias("at"),
                        F.when(p["learn"], F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    text = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END))
    return talks.select("conv_id", text.alias("formatted"),
                        F.aggregate("parts", nothing, onward, lambda done: done["spans"]).alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Back from ``format_chats``: conv_id, turns (role, text) in order, and the text under the loss mask."""
    pieces = F.split("formatted", r"<\|im_start\|>")  # the first is empty
    blocks = F.slice(pieces, F.lit(2), F.size(pieces))

    def taken(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>"),
                           lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["chars"]))), "")
    return formatted.select("conv_id", F.flatten(F.transform(blocks, taken)).alias("turns"), learnt.alias("loss_text"), "formatted")
