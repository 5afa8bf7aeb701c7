"""Review sessions as an event log: what toggles, edits, undo and clearing leave behind. Every fold is one grouped aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def toggled(log: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """(key, selected, n_toggles, last event): an odd number of toggles selects."""
    n = F.count("*")
    return log.groupBy(*key).agg((n % 2 == 1).alias("selected"), n.alias("n_toggles"), F.max(order).alias("last_event"))


def last_edit(log: DataFrame, key: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """The values of each key's last edit."""
    last = F.max(F.struct(order, *values)).alias("m")
    return log.groupBy(*key).agg(last).select(*key, *[F.col(f"m.{v}").alias(v) for v in values], F.col(f"m.{order}").alias(order))


def since_cleared(log: DataFrame, key: Sequence[str], order: str, clears: str) -> DataFrame:
    """The events of each key after its last clearing."""
    cleared = log.where(F.col(clears)).groupBy(*key).agg(F.max(order).alias("_at"))
    return log.join(cleared, list(key), "left").where(F.col("_at").isNull() | (F.col(order) > F.col("_at"))).drop("_at")


def undone(log: DataFrame, key: Sequence[str], order: str, undo: str) -> DataFrame:
    """What is left of each key's additions when every undo takes away the latest one that still stands.

    An addition stands if no later undo reaches it: counting from the end, undos less additions never exceed what came
    between. Depth is a running sum by key; an addition stands if no later depth falls below its own.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(order)
    depth = log.withColumn("_depth", F.sum(F.when(F.col(undo), -1).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.min("_depth").over(w.rowsBetween(1, Window.unboundedFollowing))
    return depth.withColumn("_later", later).where(~F.col(undo) & (F.col("_later").isNull() | (F.col("_later") >= F.col("_depth")))).drop("_depth", "_later")


def batch(candidates: DataFrame, batch_id: int) -> DataFrame:
    """The selected candidates that need no manual value, numbered as one batch."""
    from pyspark.sql import Window

    chosen = candidates.where("selected and not manual_required")
    w = Window.partitionBy("page_key").orderBy("y0", "x0", "line_id")
    return chosen.withColumn("batch_id", F.lit(batch_id)).withColumn("ordinal", F.row_number().over(w) - 1)


def removed(additions: DataFrame, bands: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """additions and bands without those of (batch_id, ordinal) in gone; a band goes with an addition of which it covers 35 %."""
    from calibra.functions import geometry as g

    hit = additions.join(gone, ["batch_id", "ordinal"], "left_semi")
    over = g.share_of_smaller(g.Rect.of("b"), g.Rect.of("a")) >= 0.35
    left = bands.alias("b").join(hit.alias("a"), (F.col("b.page_key") == F.col("a.page_key")) & over, "left_anti")
    return additions.join(gone, ["batch_id", "ordinal"], "left_anti"), left


def state(items: DataFrame, candidates: DataFrame, page: Column) -> DataFrame:
    """One row of what a session shows: candidates and how many are selected, and a page's added, replaced and struck sizes. items: (page, kind); candidates: (selected)."""
    on_page = lambda kind: F.count_if((F.col("page") == page) & (F.col("kind") == kind))
    shown = candidates.agg(F.count("*").alias("candidate_count"), F.count_if(F.coalesce("selected", F.lit(False))).alias("selected_count"))
    made = items.agg(on_page("dimension").alias("added_count"), on_page("replacement").alias("replacement_count"), on_page("strike").alias("struck_count"))
    return shown.join(made)


def state_json(states: DataFrame) -> DataFrame:
    """(state): each row as JSON text, with its fields in order."""
    return states.select(F.to_json(F.struct(*states.columns)).alias("state"))


# The least and the largest size of what is edited, and by which of its two scales it grows.
SIZES = {"stamp": (24, 180, "max"), "dimension": (5, 36, "max"), "replacement": (5, 36, "max"), "replacement_tolerance": (4, 36, "max"), "note": (6, 24, "max"), "tolerance": (4, 24, "min")}


def resized(kind: Column, size: Column, x_scale: Column, y_scale: Column) -> Column:
    """The size of an item after it was scaled in both directions, within the limits of its kind; null for a kind without any."""
    out = None
    for name, (low, high, by) in SIZES.items():
        scale = F.greatest(x_scale, y_scale) if by == "max" else F.least(x_scale, y_scale)
        held = F.greatest(F.least(size * scale, F.lit(float(high))), F.lit(float(low)))
        out = F.when(kind == name, held) if out is None else out.when(kind == name, held)
    return out
