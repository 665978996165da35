"""Chat formatting with Spark expressions only.

``<|turn|>role<|text|>text<|end|>\\n`` for every run of turns of one role; the texts of merged turns are
parted by ``<|part|>``. Inside roles and texts every ``<|``, ``<\\|``, ``<\\\\|`` ... gets one more backslash, so
no text holds a control string and reading back takes one backslash away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _split(text: Column, mark: str) -> Column:
    return F.split(text, mark.replace("|", r"\|"))


def format_chats(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    turns: conv_id, turn, role, text. Turns are sorted by (turn, role, text), null turns first; null roles
    and texts are empty. Repeated rows are turns of their own; a null conv_id is one conversation; other
    columns are ignored. loss_spans: [start, end) in code points of every ``learn_role`` text.
    A conversation becomes one string and so has to fit into a row, as the output asks, however long its texts
    are. An empty table gives an empty result.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(turns: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            same_before = (i > 0) & (F.try_element_at(turns, i)["role"] == x["role"])
            same_after = F.coalesce(F.try_element_at(turns, i + 2)["role"] == x["role"], F.lit(False))
            head = F.when(F.coalesce(same_before, F.lit(False)), F.lit(PART)).otherwise(F.concat(F.lit(TURN), escaped(x["role"]), F.lit(TEXT)))
            return F.struct(
                head.alias("head"), escaped(x["text"]).alias("body"), F.when(same_after, F.lit("")).otherwise(F.lit(END)).alias("tail"), (x["role"] == learn_role).alias("learn")
            )

        # element_at counts from 1; index 0 is asked for by no branch that is taken
        return F.transform(turns, lambda x, i: F.when(i == 0, piece(x, F.lit(0))).otherwise(piece(x, i)))

    chats = chats.select("conv_id", pieces(F.col("turns")).alias("pieces"))
    return chats.select("conv_id", _formatted(F.col("pieces")).alias("formatted"), _loss_spans(F.col("pieces")).alias("loss_spans"))


def _formatted(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], p["tail"])), "")


def _loss_spans(pieces: Column) -> Column:
    """Walks over the pieces with the length so far, keeping the spans of those to learn."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        lo = acc["at"] + F.length(p["head"])
        hi = lo + F.length(p["body"])
        span = F.array(F.struct(lo.alias("start"), hi.alias("end")))
        return F.struct((hi + F.length(p["tail"])).alias("at"), F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step)["spans"]


def read_chats(formatted: DataFrame) -> DataFrame:
    """Reads ``format_chats`` back: conv_id, turns (array of role, text), loss_text, formatted."""
    blocks = _split(F.col("formatted"), END)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns_of(block: Column) -> Column:
        halves = _split(F.substring(block, len(TURN) + 1, 2**31 - 1), TEXT)
        return F.transform(_split(halves[1], PART), lambda t: F.struct(unescaped(halves[0]).alias("role"), unescaped(t).alias("text")))

    turns = F.flatten(F.transform(blocks, turns_of))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")
