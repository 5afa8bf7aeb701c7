"""Chat formatting by perspective: a dialogue once for each participant, who speaks as the assistant in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turn numbers to a part, and turns to a piece of it: a piece is one row, which bounds what a row holds of a long conversation.
PART = 256


def _safe(text: Column) -> Column:
    """Markers inside a text lose their meaning: a space goes after their first character."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))


def perspectives(turns: DataFrame, system_roles: Sequence[str] = ("system",), part: int = PART) -> DataFrame:
    """(conv_id, speaker, part, piece, n_turns, n_own, rendered, mask_starts, mask_ends) of a table (conv_id, turn, role, text).

    One row for each conversation, participant (distinct role besides system_roles), part and piece; a part is the turns
    whose number divided by `part` gives it, a piece is `part` of its turns at most, so that a conversation of any length
    is rendered in rows of bounded size. In `rendered` the participant's turns stand as assistant, others as "user
    name=<role>", and system turns as system, in order of (turn, role, text); every piece but a conversation's first
    begins with the conversation's first system turn, if it has one. n_turns counts the piece's own turns. mask_starts
    and mask_ends give the characters of `rendered` (from 0, end excluded) on which a model is to be trained: the
    participant's texts with their end markers. A piece without a turn of the participant has empty masks.

    Null roles stand as role "unknown", null texts as empty ones; null turns come in part -1, after which they can't be
    placed; null conv_ids form one conversation of their own. Repeated rows are rendered again. A conversation of system
    turns alone has no participant and gives no row; an empty table gives an empty one. Markers in texts and roles are
    broken up by a space, and line feeds in roles become spaces. Other columns aren't read.
    """
    number = F.coalesce(F.floor(F.col("turn") / part).cast("long"), F.lit(-1).cast("long"))
    # a null conv_id gets a key of its own, so that plain equality deals and joins all rows alike
    own_key = [F.coalesce("conv_id", F.lit(0).cast(turns.schema["conv_id"].dataType)).alias("key"), F.col("conv_id").isNull().alias("no_key")]
    key = ["key", "no_key"]
    rows = turns.select("conv_id", *own_key, number.alias("part"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # who speaks in which part is found without the texts, which are shuffled once; of a conversation's texts one goes along
    system, turn = F.col("role").isin(*system_roles), F.struct("turn", "role", "text")
    roles = rows.select(*key, "part", "role").distinct()
    speakers = roles.where(~system).select(*key, F.col("role").alias("speaker")).distinct()
    whole = rows.groupBy(*key).agg(F.min("part").alias("first"), F.min(F.when(system, turn)).alias("opening"))
    wanted = roles.select(*key, "part").distinct().join(speakers, key).join(whole, key)
    place = F.row_number().over(Window.partitionBy(*key, "part").orderBy("turn", "role", "text")) - 1
    pieces = rows.withColumn("piece", F.floor(place / part).cast("long")).groupBy(*key, "part", "piece").agg(F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("turns"))
    both = pieces.join(wanted, [*key, "part"])
    own = lambda t: t.role == F.col("speaker")
    who = lambda t: F.when(own(t), "assistant").when(t.role.isin(*system_roles), "system").otherwise(F.concat(F.lit("user name="), _safe(F.translate(t.role, "\n\r", "  "))))
    line = lambda t: F.struct(own(t).alias("own"), F.concat(F.lit(OPEN), who(t), F.lit("\n")).alias("head"), F.concat(_safe(t.text), F.lit(CLOSE)).alias("body"))
    later = (F.col("part") != F.col("first")) | (F.col("piece") > 0)
    opening = F.when(later & F.col("opening").isNotNull(), F.transform(F.array("opening"), line)).otherwise(F.slice(F.transform(F.array("opening"), line), 1, 0))
    both = both.select("conv_id", "speaker", "part", "piece", F.size("turns").cast("long").alias("n_turns"), F.concat(opening, F.transform("turns", line)).alias("lines"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"), F.array().cast("array<bigint>").alias("ends"))

    def step(state: Column, line: Column) -> Column:
        start = state.at + F.length(line.head)
        end = start + F.length(line.body)
        return F.struct(
            (end + 1).cast("long").alias("at"),
            F.when(line.own, F.concat(state.starts, F.array(start.cast("long")))).otherwise(state.starts).alias("starts"),
            F.when(line.own, F.concat(state.ends, F.array(end.cast("long")))).otherwise(state.ends).alias("ends"),
        )

    return both.select(
        "conv_id", "speaker", "part", "piece", "n_turns",
        F.concat(F.array_join(F.transform("lines", lambda x: F.concat(x.head, x.body)), "\n"), F.lit("\n")).alias("rendered"),
        F.aggregate("lines", zero, step).alias("mask"),
    ).select("conv_id", "speaker", "part", "piece", "n_turns", F.size("mask.starts").cast("long").alias("n_own"), "rendered", F.col("mask.starts").alias("mask_starts"), F.col("mask.ends").alias("mask_ends"))
