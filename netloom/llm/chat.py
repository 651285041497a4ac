"""Preference formatting with built-in functions only.

A pair is two conversations, chosen and rejected.  Their longest common prefix of turns is rendered once, as prompt; what
follows in each is its completion.  A completion comes with the spans that a loss may see: the assistant's text and end
marks; all else, headers and other roles' turns, is masked.

A conversation is one row of the result, so its turns are gathered by its number; nothing else is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and turns: array<struct<role, text>> in order of turn (ties by role, then text).

    Null roles and texts are empty; a null turn number comes first; rows without a key are left out; repeated rows count
    once.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (turns.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(one)).alias("t"))
            .select(key, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")))


def _plain(text: Column) -> Column:
    """Text that cannot be taken for a mark."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), _plain(t["role"]), F.lit(MIDDLE), _plain(t["text"]), F.lit(CLOSE))), "")


def _trained(turns: Column) -> Column:
    """array<struct<start, stop>>: in the rendered turns, what the assistant says, with its end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(s, t):
        head = s["at"] + len(OPEN) + F.length(_plain(t["role"])) + len(MIDDLE)
        text_end = head + F.length(_plain(t["text"])) + len(CLOSE)
        own = F.array(F.struct(head.cast("int").alias("start"), (text_end - 1).cast("int").alias("stop")))
        return F.struct(text_end.cast("int").alias("at"), F.when(t["role"] == "assistant", F.concat(s["out"], own)).otherwise(s["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda s: s["out"])


def _common(a: Column, b: Column) -> Column:
    """Turns that two conversations share at the start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def pair_up(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with its two arrays of turns replaced by n_common, prompt, chosen, rejected, chosen_spans and rejected_spans.

    Null arrays are empty conversations.  Equal conversations are all prompt, with empty completions.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    held = (pairs.withColumn("__a", F.coalesce(F.col(chosen), empty)).withColumn("__b", F.coalesce(F.col(rejected), empty))
            .withColumn("n_common", _common(F.col("__a"), F.col("__b"))))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    held = held.withColumn("__ra", rest(F.col("__a"))).withColumn("__rb", rest(F.col("__b")))
    return (held.withColumn("prompt", _render(F.slice("__a", F.lit(1), F.col("n_common"))))
            .withColumn(chosen, _render(F.col("__ra"))).withColumn(rejected, _render(F.col("__rb")))
            .withColumn("chosen_spans", _trained(F.col("__ra"))).withColumn("rejected_spans", _trained(F.col("__rb")))
            .drop("__a", "__b", "__ra", "__rb"))


def _last_reply(turns: Column) -> Column:
    """Place (from 1) of the assistant's last turn, 0 if there is none."""
    return F.aggregate(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0)), F.lit(0), lambda s, x: F.greatest(s, x))


def swapped_replies(turns: DataFrame) -> DataFrame:
    """conv_id, chosen and rejected for every conversation: as it is, and with its last reply replaced by that of its
    neighbour (conv_id with the lowest bit turned).

    If the neighbour is missing or has no reply, the rejected conversation ends before its last reply.  Turns after the
    replaced reply go.  A conversation without a reply is its own rejected one.
    """
    own = conversations(turns).withColumn("last", _last_reply(F.col("turns")))
    other = own.where("last > 0").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"),
                                         F.slice("turns", F.col("last"), F.lit(1)).alias("reply"))
    both = own.join(other, "conv_id", "left")
    none = F.array().cast("array<struct<role:string,text:string>>")
    cut = F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.coalesce("reply", none))
    return both.select("conv_id", F.col("turns").alias("chosen"), F.when(F.col("last") > 0, cut).otherwise(F.col("turns")).alias("rejected"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")


def preference_rows(turns: DataFrame) -> DataFrame:
    """conv_id, n_common, prompt, chosen, rejected and both completions' spans (start:stop, comma-joined)."""
    made = pair_up(swapped_replies(turns))
    return made.select("conv_id", "n_common", "prompt", "chosen", "rejected", spans_text(F.col("chosen_spans")).alias("chosen_spans"),
                       spans_text(F.col("rejected_spans")).alias("rejected_spans"))
