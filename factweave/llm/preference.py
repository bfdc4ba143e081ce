"""Preference formatting: the longest common turn prefix of two conversations once, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Roles whose words are learned.
LEARNED = ("assistant",)


def _turns(df: DataFrame, pair: str, turn: str, role: str, text: str, out: str) -> DataFrame:
    """(pair, array of (role, text) in order). Rows of one turn number count once, the least (role, text) of them."""
    spoken = F.struct(F.coalesce(col(role), F.lit("")).alias("role"), F.regexp_replace(F.coalesce(col(text), F.lit("")), r"<\|im_", "<| im_").alias("text"))
    one = df.select(col(pair).alias("pair"), col(turn).alias("turn"), spoken.alias("said")).where("pair is not null").groupBy("pair", "turn").agg(F.min("said").alias("said"))
    listed = one.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("l"))
    return listed.select("pair", F.transform("l", lambda x: x["said"]).alias(out))


def _shown(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(BREAK), turn["text"], F.lit(CLOSE))


def _mask(turns: Column, learned: tuple[str, ...]) -> Column:
    """(start, end) in code points of what is learned in the rendered turns: a learned turn's text and its end mark."""
    spans = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = acc["at"] + F.length(t["role"]) + len(OPEN) + len(BREAK)
        end = head + F.length(t["text"]) + len(CLOSE)
        mark = F.when(t["role"].isin(*learned), F.array(F.struct(head.alias("start"), (end - 1).alias("end")))).otherwise(F.array().cast(spans))
        return F.struct(end.alias("at"), F.concat(acc["spans"], mark).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text", learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row per pair: pair, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Turns are equal if role and text are. The prompt renders the longest common prefix; the completions render the
    rest of each side, and a mask's spans (start, end in code points of its completion) are what is
    learned. Equal conversations are all prompt; a side without turns, or missing, is an empty completion. Null roles
    and texts are empty; a null turn comes before all others; rows without a pair are left out; marks inside texts are broken up; repeated rows
    of a turn count once; empty tables give no rows; other columns are not read. A group is one conversation,
    which is one row of the result anyway.
    """
    sides = _turns(chosen, pair, turn, role, text, "a").join(_turns(rejected, pair, turn, role, text, "b"), "pair", "full")
    blank = F.array().cast("array<struct<role:string,text:string>>")
    sides = sides.select("pair", F.coalesce("a", blank).alias("a"), F.coalesce("b", blank).alias("b"))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    sides = sides.withColumn("n_common", F.when(differ == 0, F.size("a")).otherwise(differ - 1).cast("int"))
    tail = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    sides = sides.select("pair", "n_common", F.slice("a", F.lit(1), F.col("n_common")).alias("p"), tail("a").alias("a"), tail("b").alias("b"))
    shown = lambda c: F.array_join(F.transform(c, _shown), "")
    return sides.select(F.col("pair").alias(pair), "n_common", shown("p").alias("prompt"), shown("a").alias("chosen"), shown("b").alias("rejected"), _mask(F.col("a"), learned).alias("chosen_mask"), _mask(F.col("b"), learned).alias("rejected_mask"))
