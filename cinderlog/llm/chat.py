"""Preference pairs: shared turns once as the prompt, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turn numbers that share one output row.
PART_TURNS = 32
SIDES = ("chosen", "rejected")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(
        F.coalesce(role, F.lit("unknown")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )


def _rendered(turn: Column) -> tuple[Column, Column]:
    """The opening and the body of a turn in the training text."""
    return (
        F.concat(F.lit("<|"), turn["role"], F.lit("|>\n")),
        F.concat(turn["text"], F.lit("<|end|>\n")),
    )


def _segment(turns: Column, masked: bool) -> tuple[Column, Column]:
    """Text of the turns and the spans of it that carry loss (``start:end``, code points)."""
    ordered = F.array_sort(F.filter(turns, lambda item: item["turn"].isNotNull()))
    text = F.array_join(
        F.transform(ordered, lambda item: F.concat(*_rendered(item["said"]))), ""
    )
    if not masked:
        return text, F.lit("")

    def step(state: Column, item: Column) -> Column:
        opening, body = (F.length(piece) for piece in _rendered(item["said"]))
        begin = state["at"] + opening
        span = F.concat(begin.cast("string"), F.lit(":"), (begin + body).cast("string"))
        trained = item["said"]["role"] == "assistant"
        return F.struct(
            (begin + body).alias("at"),
            F.when(trained, F.array_append(state["spans"], span))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return text, F.array_join(F.aggregate(ordered, start, step)["spans"], ",")


def format_preferences(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Training rows of preference pairs.

    ``turns``: ``pair_id, side ('chosen' or 'rejected'), turn, role, text``; other columns are
    ignored.  The prompt is the longest common prefix of turns: all turns before the first turn
    number at which the sides differ in role or text, or which only one side has.  It is rendered
    once; what follows is rendered for either side with the spans of assistant turns, the only
    ones that carry loss.

    Result: ``pair_id, part, prompt, chosen, rejected, chosen_spans, rejected_spans,
    n_prompt_turns, n_chosen_turns, n_rejected_turns``.  A part holds the turns numbered
    ``part * part_turns`` and up, so that no row gathers an unbounded conversation; texts of the
    parts joined in order are the whole texts, and spans count from their part's start.

    Rows without pair, known side or turn number have no place in a pair and are left out.  A null role
    reads ``unknown`` and a null text is empty.  Of several rows for one turn the one that is least by (role,
    text) counts.  A pair with equal sides has empty completions, one without a shared first turn
    an empty prompt.
    """
    kept = turns.where(
        F.col("pair_id").isNotNull() & F.col("turn").isNotNull() & F.col("side").isin(*SIDES)
    )
    said = _turn(F.col("role"), F.col("text"))
    by_turn = kept.groupBy("pair_id", "turn").agg(
        *(F.min(F.when(F.col("side") == side, said)).alias(side) for side in SIDES)
    )
    parts = F.floor(F.col("turn") / F.lit(part_turns)).cast("long")
    # A turn beyond all turns where the sides are equal, so that they are prompt as a whole.
    split = by_turn.groupBy("pair_id").agg(
        F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("turn"))).alias("_split")
    )
    shared = F.col("_split").isNull() | (F.col("turn") < F.col("_split"))

    def gathered(said: Column, where: Column) -> Column:
        item = F.struct(F.col("turn").alias("turn"), said.alias("said"))
        return F.collect_list(F.when(where & said.isNotNull(), item))

    segments = {"prompt": gathered(F.col("chosen"), shared)} | {
        side: gathered(F.col(side), ~shared) for side in SIDES
    }
    grouped = (
        by_turn.join(split, "pair_id")
        .groupBy("pair_id", parts.alias("part"))
        .agg(*(turns_of.alias(f"_{name}") for name, turns_of in segments.items()))
    )
    shown = {name: _segment(F.col(f"_{name}"), name != "prompt") for name in segments}
    return grouped.select(
        "pair_id",
        "part",
        *(shown[name][0].alias(name) for name in segments),
        *(shown[name][1].alias(f"{name}_spans") for name in SIDES),
        *(F.size(f"_{name}").cast("long").alias(f"n_{name}_turns") for name in segments),
    )


def alternative_replies(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations, as input of ``format_preferences``.

    Every conversation is the chosen side of a pair of its own.  The rejected side has the same
    turns up to its last assistant turn, in whose place stands the last assistant reply of the
    neighbour (``conv_id`` with the lowest bit flipped).  Without a reply or a neighbour with
    one, the rejected side ends before the last assistant turn.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where(
        F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    )
    last = turns.where(F.col("role") == "assistant").groupBy("conv_id").agg(
        F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last")
    )
    other = last.select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("text")
    )
    place = last.select("conv_id", F.col("last.turn").alias("_last"))
    before = (
        turns.join(place, "conv_id", "left")
        .where(F.col("_last").isNull() | (F.col("turn") < F.col("_last")))
        .select("conv_id", "turn", "role", "text")
    )
    replies = place.join(other, "conv_id").select(
        "conv_id", F.col("_last").alias("turn"), F.lit("assistant").alias("role"), "text"
    )
    sides = (turns, "chosen"), (before.unionByName(replies), "rejected")
    chosen, rejected = (
        rows.select(F.col("conv_id").alias("pair_id"), F.lit(side).alias("side"), "turn", "role", "text")
        for rows, side in sides
    )
    return chosen.unionByName(rejected)
