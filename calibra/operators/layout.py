"""Places for labels, and strips that must not lie over one another."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions import geometry as g
from calibra.operators.consensus import Reading

RINGS, MARGIN, HIT = 5, 3.0, 10_000.0


def offsets(width: Column, height: Column) -> Column:
    """array of structs (n, dx, dy): the place itself, then five rings of eight places around it."""
    sx, sy = F.greatest(F.lit(16.0), width * 0.58), F.greatest(F.lit(14.0), height + 6.0)
    ways = ((0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (1, -1), (-1, 1), (1, 1))
    spots = [(0, 0)] + [(x * k, y * k) for k in range(1, RINGS + 1) for x, y in ways]
    return F.array(*[F.struct(F.lit(n).alias("n"), (sx * x).alias("dx"), (sy * y).alias("dy")) for n, (x, y) in enumerate(spots)])


def place_labels(labels: DataFrame, occupied: DataFrame, page_w: float, page_h: float, page: str = "page_key") -> DataFrame:
    """(page, label_id, dx, dy, collisions): where each label of (x0, y0, x1, y1) goes.

    The first place on the page, in order of the rings, that meets nothing occupied; if there is none, the one of the
    least distance with a heavy charge for each collision. Places are rows, so every label is tried at once; labels
    don't see one another.
    """
    tried = labels.withColumn("_o", F.explode(offsets(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))))
    tried = tried.select(page, "label_id", F.col("_o.n").alias("n"), F.col("_o.dx").alias("dx"), F.col("_o.dy").alias("dy"), *[(F.col(c) + F.col(f"_o.d{c[0]}")).alias(c) for c in ("x0", "y0", "x1", "y1")])
    tried = tried.where((F.col("x0") >= MARGIN) & (F.col("y0") >= MARGIN) & (F.col("x1") <= page_w - MARGIN) & (F.col("y1") <= page_h - MARGIN))
    met = tried.alias("l").join(occupied.alias("o"), (F.col(f"l.{page}") == F.col(f"o.{page}")) & g.meet(g.Rect.of("l"), g.Rect.of("o")), "left")
    scored = met.groupBy(*[F.col(f"l.{c}").alias(c) for c in (page, "label_id", "n", "dx", "dy")]).agg(F.count("o.x0").alias("collisions"))
    cost = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) + F.col("collisions") * HIT
    # a clean place counts by its turn alone, before any other
    order = F.struct(F.when(F.col("collisions") == 0, 0).otherwise(1).alias("a"), F.when(F.col("collisions") == 0, F.lit(0.0)).otherwise(cost).alias("b"), F.col("n"))
    best = F.min_by(F.struct("dx", "dy", "collisions"), order).alias("m")
    return scored.groupBy(page, "label_id").agg(best).select(page, "label_id", "m.dx", "m.dy", "m.collisions")


def absorb(strips: DataFrame, pink: str, yellow: str, page: str = "page_key") -> DataFrame:
    """strips with short pink ones made yellow where a long yellow one runs on beside them (horizontal strips)."""
    a, b = g.Rect.of("l"), g.Rect.of("o")
    gap = F.greatest(F.lit(0.0), F.greatest(a.x0, b.x0) - F.least(a.x1, b.x1))
    across = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    near = (b.width >= F.greatest(F.lit(18.0), a.width * 1.2)) & (a.width <= 36.0) & (gap <= 6.0) & (across >= 0.65 * F.least(a.height, b.height))
    long = strips.where(F.col("color") == yellow).select(page, "x0", "y0", "x1", "y1")
    taken = strips.where(F.col("color") == pink).alias("l").join(long.alias("o"), (F.col(f"l.{page}") == F.col(f"o.{page}")) & near, "left_semi").select(page, "line_id").withColumn("_taken", F.lit(True))
    return strips.join(taken, [page, "line_id"], "left").withColumn("color", F.when(F.col("_taken"), yellow).otherwise(F.col("color"))).drop("_taken")


def part_overlaps(strips: Sequence[Reading], sweeps: int = 4, gap: float = 1.2) -> list[Reading]:
    """Strips cut in the middle of what they share along the line, in order, until nothing moves; their thickness stays."""
    out = list(strips)
    for _ in range(sweeps):
        moved = False
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                a, b = out[i], out[j]
                w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
                if w <= 0 or h <= 0 or w * h < 0.4:
                    continue
                middle = (max(a.x0, b.x0) + min(a.x1, b.x1)) / 2
                first, second = (i, j) if a.x0 + a.x1 <= b.x0 + b.x1 else (j, i)
                left, right = replace(out[first], x1=min(out[first].x1, middle - gap / 2)), replace(out[second], x0=max(out[second].x0, middle + gap / 2))
                if left.w > gap and right.w > gap:
                    out[first], out[second], moved = left, right, True
        if not moved:
            break
    return out
