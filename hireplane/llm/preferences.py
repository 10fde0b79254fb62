"""Preference formatting: a chosen and a rejected conversation become one prompt and two masked completions.

The longest common prefix of turns (same role and text) is rendered once as
the prompt. The rest of either conversation is its completion, kept as parallel
arrays of rendered segments and mask bits: 1 for the assistant's words, 0 for
headers and other roles.

Null roles count as "user", null texts as empty; null turn numbers come first.
A pair whose two conversations are equal has two empty completions and
``identical`` true. A pair naming a conversation without turns has that side
empty. Ties of the turn number are ordered by role and text. Repeated rows of a
turn are kept. Only the columns named in the arguments are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, END = "<|im_start|>{role}\n", "<|im_end|>\n"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_id and its turns in order; a conversation is one training example, so its turns are one row."""
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    short = F.least(F.size(a), F.size(b))
    differs = F.filter(
        F.when(short > 0, F.sequence(F.lit(0), short - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.get(a, i)["role"] != F.get(b, i)["role"]) | (F.get(a, i)["text"] != F.get(b, i)["text"]),
    )
    return F.coalesce(F.get(differs, F.lit(0)), short)


def header(role: Column) -> Column:
    return F.concat(F.lit(HEADER.split("{")[0]), role, F.lit(HEADER.split("}")[1]))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t["role"]), t["text"], F.lit(END))), "")


def segments(turns: Column) -> Column:
    """Per turn its header and its body, each with the mask bit that a loss is weighted by."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(header(t["role"]).alias("text"), F.lit(0).alias("mask")),
        F.struct(F.concat(t["text"], F.lit(END)).alias("text"), (t["role"] == "assistant").cast("int").alias("mask")),
    )))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, chosen and rejected (arrays of turns) to prompt and masked completions."""
    empty = F.array().cast(TURNS)
    sides = pairs.select(
        "pair_id", F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"),
    )
    cut = sides.withColumn("n_prompt_turns", F.explode(F.array(common_prefix(F.col("chosen"), F.col("rejected")))))
    rest = lambda side: F.slice(side, F.col("n_prompt_turns") + 1, F.greatest(F.size(side) - F.col("n_prompt_turns"), F.lit(0)))
    done = cut.select(
        "pair_id", "n_prompt_turns", render(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        segments(rest("chosen")).alias("c"), segments(rest("rejected")).alias("r"),
    )
    return done.select(
        "pair_id", "n_prompt_turns", "prompt",
        *[F.transform(s, lambda x: x[f]).alias(f"{name}_{f}s") for s, name in (("c", "chosen"), ("r", "rejected")) for f in ("text", "mask")],
        ((F.size("c") == 0) & (F.size("r") == 0)).alias("identical"),
    )


def pair_up(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen_id, rejected_id) with the turns of both sides."""
    whole = conversations(turns)
    side = lambda name: whole.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(name))
    return pairs.join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left").select("pair_id", "chosen", "rejected")


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Pairs made of a plain conversation table.

    Chosen is the conversation up to its last assistant turn. Rejected ends in
    the last assistant reply of the conversation with the next id (missing:
    the turn is left out), so the prompt is all before the reply. Conversations
    without an assistant turn make no pair.
    """
    whole = conversations(turns)
    places = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"] == "assistant")
    known = whole.withColumn("last", F.explode(F.array(F.element_at(F.when(F.size(places) > 0, places), -1)))).where("last IS NOT NULL")
    reply = known.select((F.col("conv_id") - 1).alias("conv_id"), F.get("turns", F.col("last")).alias("other"))
    kept = F.slice("turns", F.lit(1), F.col("last"))
    return known.join(reply, "conv_id", "left").select(
        F.col("conv_id").alias("pair_id"),
        F.slice("turns", F.lit(1), F.col("last") + 1).alias("chosen"),
        F.when(F.col("other").isNull(), kept).otherwise(F.concat(kept, F.array("other"))).alias("rejected"),
    )
