"""Preference formatting: chosen and rejected conversations to prompt and masked completions.

The turns of both sides of a pair meet on (pair, turn); the first turn where they differ ends
the common prefix.  Turns before it are rendered once as the prompt, the others as the two
completions, with the spans that count for the loss (what the assistant says).  Turns shuffle
one by one, so a conversation of very many turns is spread; only the rendered pieces of one
pair come together, as they make up its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut

#: Conversations with the same opening are paired in buckets of about so many.
BUCKET = 1000
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def conversation_turns(talks: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, turn, said)``: what is said in a turn as a sorted array of ``(role, text)``.

    Rows repeated exactly count once; different rows of one turn follow one another by role and
    text.  Null roles and texts count as empty, a null turn comes last, rows without a
    conversation id belong to none and are left out.
    """
    said = F.struct(F.coalesce(column(role_col), F.lit("")).alias("role"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    turn = F.coalesce(column(turn_col).cast("long"), F.lit((1 << 63) - 1))
    return (talks.where(column(conv_col).isNotNull())
            .groupBy(column(conv_col).alias("conv"), turn.alias("turn"))
            .agg(F.sort_array(F.collect_set(said)).alias("said")))


def sibling_pairs(turns: DataFrame) -> DataFrame:
    """``(chosen, rejected)``: conversations with the same opening turn, two by two.

    The one in which the assistant says more (then the smaller id) is chosen.  Openings that very
    many share are cut into buckets by the id's hash; one conversation may stay single in each.
    """
    talk = turns.groupBy("conv").agg(
        F.min_by(F.xxhash64("said"), "turn").alias("opening"),
        F.sum(F.aggregate("said", F.lit(0), lambda a, s: a + F.when(s["role"] == "assistant", F.length(s["text"])).otherwise(0))).alias("words"))
    talk = cut(talk)
    shared = cut(talk.groupBy("opening").agg(F.count("*").alias("n")).where("n > 1"))
    bucketed = talk.join(shared, "opening").withColumn(
        "bucket", F.pmod(F.xxhash64("conv"), F.ceil(F.col("n") / BUCKET)))
    members = bucketed.groupBy("opening", "bucket").agg(F.sort_array(F.collect_list(F.struct("conv", (-F.col("words")).alias("w")))).alias("m"))
    two = members.where(F.size("m") > 1).select(F.explode(F.transform(
        F.sequence(F.lit(0), F.floor(F.size("m") / 2).cast("int") - 1),
        lambda i: F.sort_array(F.transform(F.array(F.get("m", 2 * i), F.get("m", 2 * i + 1)),
                                           lambda x: F.struct(x["w"].alias("w"), x["conv"].alias("conv")))))).alias("p"))
    return two.select(F.col("p")[0]["conv"].alias("chosen"), F.col("p")[1]["conv"].alias("rejected"))


def stale_replies(turns: DataFrame) -> DataFrame:
    """For conversations in which the assistant speaks: the same turns, with the last one of the
    assistant repeating the assistant's turn before it (empty if there is none).  A constructed
    negative for conversations without a sibling."""
    spoke = F.exists("said", lambda s: s["role"] == "assistant")
    last = turns.where(spoke).groupBy("conv").agg(F.max("turn").alias("last"))
    before = (turns.where(spoke).join(last, "conv").where("turn < last")
              .groupBy("conv").agg(F.max_by("said", "turn").alias("stale")))
    empty = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("").alias("text")))
    swap = cut(last.join(before, "conv", "left").select("conv", "last", F.coalesce("stale", empty).alias("stale")))
    return turns.join(swap, "conv").select(
        "conv", "turn", F.when(F.col("turn") == F.col("last"), F.col("stale")).otherwise(F.col("said")).alias("said"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each pair of ``chosen`` and ``rejected (pair, turn, said)``:

    ``pair, n_common`` (turns of the longest common prefix), ``prompt``, and for each side the
    completion and its mask, an array of ``(start, stop)`` code points that count for the loss: the
    assistant's texts with their end marks.  If one side is a prefix of the other its completion
    is empty; equal sides give two empty completions.  Pairs without turns do not occur.
    """
    sides = chosen.select("pair", "turn", F.col("said").alias("c"), F.lit(None).cast(chosen.schema["said"].dataType).alias("r")).unionByName(
        rejected.select("pair", "turn", F.lit(None).cast(chosen.schema["said"].dataType).alias("c"), F.col("said").alias("r")))
    both = cut(sides.groupBy("pair", "turn").agg(F.max("c").alias("c"), F.max("r").alias("r")))
    differ = cut(both.groupBy("pair").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("split")))

    def rendered(said):
        return F.transform(said, lambda s: F.struct(
            F.concat(F.lit(OPEN), s["role"], F.lit("\n"), s["text"], F.lit(CLOSE)).alias("text"),
            F.when(s["role"] == "assistant", F.length(F.concat(F.lit(OPEN), s["role"], F.lit("\n")))).alias("skip")))

    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    pieces = both.join(differ, "pair").select(
        "pair", "turn", common.alias("common"), rendered(F.col("c")).alias("c"), rendered(F.col("r")).alias("r"))
    rows = pieces.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("turn", "common", "c", "r"))).alias("t"))

    def joined(parts):
        return F.array_join(F.transform(parts, lambda x: x["text"]), "")

    def mask(parts):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("m"))
        step = lambda a, x: F.struct(
            (a["at"] + F.length(x["text"])).alias("at"),
            F.when(x["skip"].isNull(), a["m"]).otherwise(F.concat(a["m"], F.array(F.struct(
                (a["at"] + x["skip"]).alias("start"), (a["at"] + F.length(x["text"]) - 1).alias("stop"))))).alias("m"))
        return F.aggregate(parts, start, step, lambda a: a["m"])

    def side(name, keep_common):
        kept = F.filter("t", lambda x: x["common"] if keep_common else ~x["common"])
        return F.flatten(F.transform(kept, lambda x: F.coalesce(x[name], F.array().cast(
            "array<struct<text:string,skip:int>>"))))

    parts = rows.select("pair", F.size(F.filter("t", lambda x: x["common"])).cast("long").alias("n_common"),
                        side("c", True).alias("p"), side("c", False).alias("c"), side("r", False).alias("r"))
    return parts.select("pair", "n_common", joined("p").alias("prompt"),
                        joined("c").alias("chosen_text"), mask(F.col("c")).alias("chosen_mask"),
                        joined("r").alias("rejected_text"), mask(F.col("r")).alias("rejected_mask"))


def preference_rows(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """Preference rows of a table of conversations.

    Conversations with the same opening turn are paired; each of the others in which the
    assistant speaks is paired with itself ending in a stale reply (``rejected_id`` is null
    then).  Conversations without a reply and without a sibling give no row.
    """
    turns = cut(conversation_turns(talks, conv_col, turn_col, role_col, text_col))
    pairs = cut(sibling_pairs(turns))
    paired = pairs.select(F.explode(F.array("chosen", "rejected")).alias("conv"))
    single = turns.join(paired, "conv", "left_anti")
    spoke = single.where(F.exists("said", lambda s: s["role"] == "assistant")).select("conv").distinct()
    left = pairs.select("chosen", F.col("rejected").alias("other"))
    chosen = turns.join(left, F.col("conv") == F.col("chosen")).select(
        F.struct("chosen", "other").alias("pair"), "turn", "said").unionByName(
        single.join(spoke, "conv", "left_semi").select(
            F.struct(F.col("conv").alias("chosen"), F.lit(None).cast(turns.schema["conv"].dataType).alias("other")).alias("pair"), "turn", "said"))
    rejected = turns.join(left, F.col("conv") == F.col("other")).select(
        F.struct("chosen", "other").alias("pair"), "turn", "said").unionByName(
        stale_replies(single).select(
            F.struct(F.col("conv").alias("chosen"), F.lit(None).cast(turns.schema["conv"].dataType).alias("other")).alias("pair"), "turn", "said"))
    return format_preferences(chosen, rejected).select(
        F.col("pair.chosen").alias("chosen_id"), F.col("pair.other").alias("rejected_id"),
        "n_common", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")
