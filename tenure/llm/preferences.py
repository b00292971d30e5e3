"""Preference formatting of chosen and rejected conversations (operator 9, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the rendered form.
OPEN, CLOSE = "<|", "|>"
END = "<|end|>\n"
TRAINED = "assistant"


def render(turn: Column) -> Column:
    """One turn as text; marks inside it are taken apart so that nobody can write a turn of another role."""
    safe = lambda c: F.replace(c, F.lit(OPEN), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(turn["role"]), F.lit(CLOSE + "\n"), safe(turn["text"]), F.lit(END))


def _spans(turns: Column) -> Column:
    """Character ranges [first, last) of the completion that are trained on: the replies and their end marks."""
    walked = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(render(t))).alias("at"),
            F.when(
                t["role"] == TRAINED,
                F.concat(a["spans"], F.array(F.struct(
                    (a["at"] + F.lit(len(OPEN) + len(TRAINED) + len(CLOSE) + 1)).alias("first"),
                    (a["at"] + F.length(render(t))).alias("last"),
                ))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return walked


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Pairs out of conversations without preference labels, as rows for ``format_pairs``.

    Takes (conv_id, turn, role, text). Chosen is a conversation as it is; rejected has the
    same turns, the last with the text of another conversation's last turn: the partner of
    2k is 2k + 1 and the other way round, so pairs share all turns before the last reply.
    Without a partner the reply is empty. Rows that share the last turn's number all get the
    partner's text. A null conv_id is a conversation of its own, without a partner.
    """
    said = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    last = turns.groupBy(F.col("conv_id").alias("_conv")).agg(F.max(said).alias("_last"))
    other = last.select(F.col("_conv").bitwiseXOR(F.lit(1)).alias("_of"), F.col("_last.text").alias("_reply"))
    ends = last.join(other, F.col("_conv") == F.col("_of"), "left").select("_conv", F.col("_last.turn").alias("_turn"), F.coalesce("_reply", F.lit("")).alias("_reply"))
    rows = turns.select("conv_id", "turn", "role", "text").join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")))
    sides = rows.withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    swapped = (F.col("side") == "rejected") & (F.col("turn") == F.col("_turn"))
    return sides.select(F.col("conv_id").alias("pair_id"), "side", "turn", "role", F.when(swapped, F.col("_reply")).otherwise(F.col("text")).alias("text"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """Prompt and masked completions of every pair.

    Takes (pair_id, side, turn, role, text), side being 'chosen' or 'rejected'. The
    longest run of first turns with the same role and text on both sides is rendered
    once as prompt; the rest of each side is its completion, with the ranges that the
    loss covers (assistant turns) beside it.

    Turns go by turn (null first), then role, then text; repeated rows are turns of
    their own; a null role is 'unknown', a null text empty, any other side than
    'rejected' counts as chosen, rows with a null pair_id are one pair. A side without
    turns has no common prefix and an empty completion. An empty table gives an empty
    result; other columns are not read. A conversation is one row of the result, so its
    turns meet in one task; nothing larger than a pair does.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rejected = F.coalesce(F.col("side") == "rejected", F.lit(False))
    sides = turns.select(F.col("pair_id").cast("long").alias("pair_id"), rejected.alias("rejected"), turn.alias("t")).groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("rejected"), F.col("t")))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("rejected"), F.col("t")))).alias("r"),
    )
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    cut = sides.withColumn("n_prompt", F.when(differs > 0, differs - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int"))
    rest = lambda side: F.slice(side, F.col("n_prompt") + 1, F.greatest(F.size(side) - F.col("n_prompt"), F.lit(0)))
    parts = cut.withColumn("cc", rest("c")).withColumn("rr", rest("r"))
    text = lambda a: F.array_join(F.transform(a, render), "")
    return parts.select(
        "pair_id",
        F.col("n_prompt").cast("long").alias("n_prompt_turns"),
        F.size("cc").cast("long").alias("n_chosen_turns"),
        F.size("rr").cast("long").alias("n_rejected_turns"),
        text(F.slice("c", 1, F.col("n_prompt"))).alias("prompt"),
        text(F.col("cc")).alias("chosen"),
        _spans(F.col("cc")).alias("chosen_spans"),
        text(F.col("rr")).alias("rejected"),
        _spans(F.col("rr")).alias("rejected_spans"),
    )
