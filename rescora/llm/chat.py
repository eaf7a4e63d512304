"""Multi-party perspective rotation of dialogues.

For every participant of a dialogue, the dialogue is rendered with that speaker's turns as `assistant` and everyone
else's as a named `user`; system turns stay `system`. The mask lists the spans of code points that the loss is taken
over: the content and closing mark of each turn of that speaker. Native expressions only.

Every participant of the whole dialogue gets every turn, whether they speak in it or not. A row is a whole dialogue, or,
with `part`, so many turns by their rank, however sparse their numbers: then no row or task grows with the longest
dialogue, and the parts of a perspective, put together without the turns that lead them again, are the whole. The system
turns that come before all others lead each further part again; n_turns doesn't count these again.

Nulls and ties: a null conv_id is a dialogue of its own; a null turn counts as turn 0, before it by order; null text is
empty; a null or empty role is `unknown`. Turns of equal number are in order of role and text; repeated rows are turns
of their own. A dialogue with only system turns has no perspectives and no rows. Marks inside a text are opened up
("<|" becomes "< |"), and characters other than letters, digits, "_" and "-" in a name become "_". Extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_sum

#: Turns of a cell in which ranks are counted.
CELL = 512
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def speaker_name(role: Column) -> Column:
    name = F.regexp_replace(F.coalesce(role, F.lit("")), r"[^\p{L}\p{N}_-]", "_")
    return F.when(name == "", F.lit("unknown")).otherwise(name)


def rotate(turns: DataFrame, part: int | None = None) -> DataFrame:
    """conv_id, part, speaker, text, mask (array of start and end, end exclusive), n_turns, n_spoken.

    Ranks are running sums over cells of turn numbers; one more shuffle gathers the turns of each part, and names and
    leading system turns come to the parts by (dialogue, part). Rendering is by expressions over the sorted array.
    """
    part = part or 1 << 60
    number = F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long"))
    # keys without nulls
    rows = turns.select(
        "conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_key"), F.floor(number / CELL).alias("_cell"),
        F.struct(
            F.col("turn").isNotNull().alias("k"), number.alias("turn"), speaker_name(F.col("role")).alias("who"), _safe(F.col("text")).alias("said")
        ).alias("_turn"),
    )
    # a null turn has number 0, and its rank is before it
    rows = running_sum(rows, {"_at": F.lit(1)}, ["_key"], "_cell", [F.col("_turn.turn"), F.col("_turn")])
    turn = F.struct("_turn.turn", "_turn.k", "_turn.who", "_turn.said", "_at")
    rows = rows.groupBy("_key", F.floor((F.col("_at") - 1) / part).alias("part")).agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("_turns")
    )
    said = F.filter("_turns", lambda t: t["who"] != SYSTEM)
    first = F.coalesce(F.get(said, F.lit(0))["_at"], F.lit((1 << 63) - 1))
    heads = rows.select(
        "_key", "part", first.alias("_first"), F.array_distinct(F.transform(said, lambda t: t["who"])).alias("_who"),
        F.filter("_turns", lambda t: t["_at"] < first).alias("_lead"),
    )
    heads = heads.groupBy("_key").agg(
        F.min("_first").alias("_first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_who")))).alias("_who"),
        F.flatten(F.collect_list("_lead")).alias("_lead"), F.collect_list("part").alias("_parts"),
    )
    lead = F.sort_array(F.filter("_lead", lambda t: t["_at"] < F.col("_first")))
    heads = heads.select("_key", F.explode("_parts").alias("part"), "_who", lead.alias("_lead"))
    rows = rows.join(heads, ["_key", "part"])
    again = F.filter("_lead", lambda t: t["_at"] <= F.col("part") * part)
    rows = rows.withColumn("_own", F.size("_turns")).withColumn("_turns", F.concat(again, "_turns")).withColumn("speaker", F.explode("_who"))

    def heading(t: Column) -> Column:
        named = F.concat(F.lit("user name="), t["who"])
        kind = F.when(t["who"] == SYSTEM, F.lit(SYSTEM)).when(t["who"] == F.col("speaker"), F.lit("assistant")).otherwise(named)
        return F.concat(F.lit(OPEN), kind, F.lit("\n"))

    pieces = F.transform(
        "_turns",
        lambda t: F.struct(heading(t).alias("head"), F.concat(t["said"], F.lit(CLOSE)).alias("body"), (t["who"] == F.col("speaker")).alias("own")),
    )
    rows = rows.withColumn("_pieces", pieces)
    lengths = F.transform("_pieces", lambda p: F.struct(F.char_length(p["head"]).alias("h"), F.char_length(p["body"]).alias("b"), p["own"].alias("own")))
    rows = rows.withColumn("_lengths", lengths)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    # every turn ends with a line break after its closing mark
    step = lambda acc, x: F.struct(
        (acc["at"] + x["h"] + x["b"] + 1).alias("at"),
        F.when(
            x["own"],
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["h"]).alias("start"), (acc["at"] + x["h"] + x["b"]).alias("end")))),
        ).otherwise(acc["spans"]).alias("spans"),
    )
    return rows.select(
        "conv_id", "part", "speaker",
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("_lengths", empty, step)["spans"].alias("mask"),
        F.col("_own").cast("long").alias("n_turns"),
        F.size(F.filter("_lengths", lambda x: x["own"])).cast("long").alias("n_spoken"),
    )
