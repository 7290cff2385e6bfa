"""Preference formatting with DataFrame functions only: one prompt, two masked completions a pair.

Input: turns of pairs, one row a turn: pair_id, side ("chosen" or "rejected"), turn, role, text. The longest common
prefix of turns (equal role and text) is rendered once as the prompt; what is left of each side is its completion.
A completion is rendered with the same template, and its mask marks the character spans to train on: the texts of
assistant turns with their end mark. Everything else, prompt included, is masked out.

Conversations are gathered a side of a pair, never across pairs, so a turn that a third of all pairs share meets
nobody. Cases: a null role is "user", a null text is empty; turns are ordered by turn (null first), then role and text,
so ties and repeated rows have a fixed order and repeated turns stay; a pair without one of its sides has an empty
completion on that side and no prompt; sides that are equal have empty completions; rows of a null pair_id or of another
side are left out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _side(name: str) -> Column:
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return F.sort_array(F.collect_list(F.when(F.col("side") == name, turn)))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Spans [start, end) in characters of the assistant texts with their end marks."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s, t):
        text = s["at"] + len(OPEN) + F.length(t["role"]) + len(CLOSE)
        end = text + F.length(t["text"]) + len(END)
        span = F.array(F.struct(text.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(turns: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, and for chosen and rejected: <side>_turns, <side>, <side>_mask."""
    pairs = turns.where("pair_id is not null and side in ('chosen', 'rejected')").groupBy("pair_id").agg(_side("chosen").alias("c"), _side("rejected").alias("r"))
    shortest = F.least(F.size("c"), F.size("r"))
    differs = lambda i: (F.get("c", i)["role"] != F.get("r", i)["role"]) | (F.get("c", i)["text"] != F.get("r", i)["text"])
    first = F.array_min(F.filter(F.when(shortest > 0, F.sequence(F.lit(0), shortest - 1)).otherwise(F.array().cast("array<int>")), differs))
    pairs = pairs.withColumn("prompt_turns", F.coalesce(first, shortest))
    rest = lambda side: F.slice(side, F.col("prompt_turns") + 1, F.size(side))
    pairs = pairs.select("pair_id", "prompt_turns", F.slice("c", 1, F.col("prompt_turns")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    sides = [x for side, c in (("chosen", "c"), ("rejected", "r")) for x in (F.size(c).alias(f"{side}_turns"), _rendered(F.col(c)).alias(side), _mask(F.col(c)).alias(f"{side}_mask"))]
    return pairs.select("pair_id", "prompt_turns", _rendered(F.col("p")).alias("prompt"), *sides)


def answers_swapped(conversations: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations (conv_id, turn, role, text): chosen is a conversation up to its last
    assistant turn, rejected is the same with that turn's text from its partner (conv_id 2k and 2k + 1 are partners).
    Conversations without an assistant turn, or whose partner has none, make no pair."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text")
    last = rows.where("role = 'assistant'").groupBy(F.col("pair_id").alias("id")).agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.col("last.text").alias("other"))
    both = rows.join(last.join(other, "id"), rows.pair_id == F.col("id"))
    final = F.col("turn").eqNullSafe(F.col("last.turn")) & (F.col("role") == "assistant") & F.col("text").eqNullSafe(F.col("last.text"))
    both = both.where(F.col("turn").isNull() | (F.col("turn") <= F.col("last.turn")))
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("t")), F.struct(F.lit("rejected").alias("side"), F.when(final, F.col("other")).otherwise(F.col("text")).alias("t"))))
    return both.select("pair_id", "turn", "role", sides.alias("s")).select("pair_id", F.col("s.side").alias("side"), "turn", "role", F.col("s.t").alias("text"))
