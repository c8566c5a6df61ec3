"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once, as the prompt; what follows
is rendered as two completions. A completion's mask is the list of lengths of its
parts in characters, in order: positive where a model learns (assistant text),
negative where it doesn't. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def _turns(conversations: DataFrame, key: str, name: str) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias(name))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    """Per turn: its head, then its text with the end mark (learned for the
    assistant)."""
    own = F.lit(len("<|end|>\n"))
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(-F.length(_head(t)), F.when(t["role"] == ASSISTANT, 1).otherwise(-1) * (F.length(t["text"]) + own)),
        )
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs by ``key`` of two tables (key, turn, role, text): n_common, prompt,
    chosen, rejected and a mask for each completion.

    Turns are in order of turn, then role and text, so ties and repeated rows have
    one order. Null roles and texts count as empty. A conversation of one table
    alone pairs with an empty one; a null key is left out; equal conversations have
    empty completions. Other columns are not looked at, whatever their names; texts of
    any length are rendered whole.
    """
    a, b = _turns(chosen, key, "a"), _turns(rejected, key, "b")
    none = F.array().cast("array<struct<turn: long, role: string, text: string>>")
    a = a.withColumn("a", F.col("a").cast("array<struct<turn: long, role: string, text: string>>"))
    b = b.withColumn("b", F.col("b").cast("array<struct<turn: long, role: string, text: string>>"))
    both = a.where(F.col(key).isNotNull()).join(b.where(F.col(key).isNotNull()), key, "full")
    both = both.select(key, F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    least = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(
        F.slice("a", F.lit(1), least), F.slice("b", F.lit(1), least), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"])
    )
    first = F.array_position(same, F.lit(False))
    both = both.withColumn("n_common", F.when(first > 0, first - 1).otherwise(least).cast("long"))
    rest = lambda c: F.slice(c, (F.col("n_common") + 1).cast("int"), F.size(c))
    return both.select(
        key,
        "n_common",
        _rendered(F.slice("a", F.lit(1), F.col("n_common").cast("int"))).alias("prompt"),
        _rendered(rest("a")).alias("chosen"),
        _rendered(rest("b")).alias("rejected"),
        _mask(rest("a")).alias("chosen_mask"),
        _mask(rest("b")).alias("rejected_mask"),
    )


def swapped_last_reply(conversations: DataFrame) -> DataFrame:
    """Conversations whose last assistant turn says what the next conversation (by
    number) answered first: rejected partners for a table that has none."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    is_reply = F.col("role") == ASSISTANT
    last = conversations.where(is_reply).groupBy("conv_id").agg(F.max("turn").alias("__last"))
    first = (
        conversations.where(is_reply).groupBy((F.col("conv_id") - 1).alias("conv_id"))
        .agg(F.min_by(F.coalesce("text", F.lit("")), F.struct("turn", F.coalesce("text", F.lit("")))).alias("__other"))
    )
    known = last.join(first, "conv_id")
    swap = is_reply & (F.col("turn") == F.col("__last"))
    return conversations.join(known, "conv_id", "left").select(
        "conv_id", "turn", "role", F.when(swap, F.col("__other")).otherwise(F.col("text")).alias("text")
    )


def formatted_pairs(conversations: DataFrame) -> DataFrame:
    pairs = format_preferences(conversations, swapped_last_reply(conversations))
    listed = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",").alias(c)
    return pairs.select("conv_id", "n_common", "prompt", "chosen", "rejected", listed("chosen_mask"), listed("rejected_mask"))
