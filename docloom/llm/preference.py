"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The turns of a pair are gathered into one row, which the pair's record needs whole in any case; all the
rest is column expressions. The longest common prefix of turns (equal role and text) is rendered once
as the prompt; what follows on each side is its completion. The mask of a completion lists the
stretches (start, end in code points) to learn from: the texts and end marks of the learning role's turns.

Defined results: turns are ordered by number, then role and text (nulls first); a null role or text is
empty; a pair of which one side is missing has an empty prompt and an empty completion on that side;
equal sides are all prompt, with empty completions; repeated turns stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def rendered(turn: Column) -> Column:
    """A turn as text: its role's mark, its text, the end mark."""
    return F.concat(head(turn["role"]), turn["text"], F.lit(END))


def _completion(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _mask(turns: Column, role: str) -> Column:
    """Stretches of the learning role's turns within the completion."""
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        end = state["at"] + F.length(rendered(turn))
        span = F.struct((state["at"] + F.length(head(turn["role"]))).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(turn["role"] == role, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda state: state["spans"])


def format_pairs(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """From turns (pair_id, rejected boolean, turn, role, text): pair_id, common_turns, prompt, chosen, rejected and their masks."""
    clean = turns.select("pair_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"), "rejected")
    side = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("t"))))
    pairs = clean.groupBy("pair_id").agg(side(~F.col("rejected")).alias("a"), side(F.col("rejected")).alias("b"))
    content = lambda t: F.struct(t["role"], t["text"])
    shorter = F.least(F.size("a"), F.size("b"))
    differs = F.zip_with(F.slice("a", F.lit(1), shorter), F.slice("b", F.lit(1), shorter), lambda x, y: content(x) != content(y))
    first = F.array_position(differs, True)
    pairs = pairs.withColumn("common_turns", F.when(first > 0, first.cast("int") - 1).otherwise(shorter))
    tail = lambda c: F.slice(c, F.col("common_turns") + 1, F.size(c))
    pairs = pairs.select("pair_id", "common_turns", F.slice("a", F.lit(1), F.col("common_turns")).alias("p"), tail("a").alias("a"), tail("b").alias("b"))
    return pairs.select(
        "pair_id",
        "common_turns",
        _completion(F.col("p")).alias("prompt"),
        _completion(F.col("a")).alias("chosen"),
        _mask(F.col("a"), role).alias("chosen_mask"),
        _completion(F.col("b")).alias("rejected"),
        _mask(F.col("b"), role).alias("rejected_mask"),
    )


def neighbouring_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as pair k; a conversation without an id is left out, as it has no partner."""
    known = conversations.where("conv_id is not null")
    return known.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 1).alias("rejected"), "turn", "role", "text")
