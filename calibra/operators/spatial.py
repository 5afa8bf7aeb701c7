"""Joins between readings of one page. All join on the page first, so they shuffle by page and never compare pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions import geometry as g
from calibra.functions.text import is_fit_deviation

RECT = ("x0", "y0", "x1", "y1")


# A number without sign, degree or point; what a fragment of a stack looks like.
BARE_WHOLE, SHORT_FRAGMENT = r"^\d+$", r"^[0-9.+\-一十]{1,3}$"


def _sided(df: DataFrame, alias: str) -> DataFrame:
    return df.alias(alias)


def drop_where(lines: DataFrame, others: DataFrame, test: Callable[[g.Rect, g.Rect], Column], page: str = "page_key") -> DataFrame:
    """The lines for which no other line of their page passes the test (an anti join). test sees columns of l and o."""
    a, b = _sided(lines, "l"), _sided(others, "o")
    return a.join(b, (F.col(f"l.{page}") == F.col(f"o.{page}")) & test(g.Rect.of("l"), g.Rect.of("o")), "left_anti")


def keep_where(lines: DataFrame, others: DataFrame, test: Callable[[g.Rect, g.Rect], Column], page: str = "page_key") -> DataFrame:
    """The lines for which some other line of their page passes the test (a semi join)."""
    a, b = _sided(lines, "l"), _sided(others, "o")
    return a.join(b, (F.col(f"l.{page}") == F.col(f"o.{page}")) & test(g.Rect.of("l"), g.Rect.of("o")), "left_semi")


def not_same() -> Column:
    return F.col("l.line_id") != F.col("o.line_id")


def richer_reading(a: g.Rect, b: g.Rect) -> Column:
    """Another line with more evidence lies over this one."""
    return not_same() & (g.share_of_smaller(a, b) >= 0.18)


def digit_echo(a: g.Rect, b: g.Rect) -> Column:
    """A bare whole number (l.text, l.nominal) whose digits stand in a richer text at the same place (o.text, as tx.normalize gives it)."""
    near = F.greatest(F.lit(5.0), F.least(F.lit(14.0), a.longer * 1.5))
    whole = F.col("l.text").rlike(BARE_WHOLE)
    digits = F.when(F.col("l.nominal") == F.floor("l.nominal"), F.col("l.nominal").cast("long").cast("string")).otherwise(F.col("l.text"))
    return not_same() & whole & F.col("o.text").contains(digits) & ((g.share_of_smaller(a, b) >= 0.18) | (g.centre_distance(a, b) <= near))


def reference(a: g.Rect, b: g.Rect) -> Column:
    """A reference dimension at the same place."""
    return (g.share_of_smaller(a, b) >= 0.22) | (g.centre_distance(a, b) <= F.greatest(F.lit(3.0), a.shorter * 0.8))


def tolerance_attached(a: g.Rect, b: g.Rect) -> Column:
    """A tolerance in the line's own height, right behind it, or starting about its lower edge."""
    level = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0) >= 0.35 * F.greatest(F.lit(1.0), F.least(a.height, b.height))
    # places and not gaps are compared, as in SQL: a limit that is just reached is rounded alike
    right = b.x0.between(a.x1 - 0.35 * a.height, a.x1 + 4.5 * a.height)
    lower = b.y0.between(a.y1 - 0.35 * a.width, a.y1 + 4.5 * a.width)
    return not_same() & level & (right | lower)


def tolerance_margin(a: g.Rect, b: g.Rect) -> Column:
    """A tolerance within a margin of 10 to 24 that grows with the line."""
    by = F.greatest(F.lit(10.0), F.least(F.lit(24.0), a.longer * 2.2))
    return not_same() & g.meet(a.grown(by), b)


def replaced(a: g.Rect, b: g.Rect) -> Column:
    return not_same() & (g.share_of_smaller(a, b) >= 0.45)


def truncated(a: g.Rect, b: g.Rect) -> Column:
    """A text at least two characters longer that ends with this one, close by."""
    return not_same() & (F.length("o.text") >= F.length("l.text") + 2) & F.col("o.text").endswith(F.col("l.text")) & (g.centre_distance(a, b) <= 58)


def stacked(lines: DataFrame, fragments: DataFrame, at_least: int = 2, page: str = "page_key") -> DataFrame:
    """Lines but bare whole numbers that have at least `at_least` short fragments (o.text of one to three digits, points and signs) about them in their column."""
    a, b = g.Rect.of("l"), g.Rect.of("o")
    column = F.abs(a.x0 + a.x1 - b.x0 - b.x1) / 2 <= F.greatest(F.lit(4.0), 1.2 * a.width)
    height = F.abs(a.y0 + a.y1 - b.y0 - b.y1) / 2 <= F.greatest(F.lit(18.0), 3.0 * a.height)
    test = not_same() & F.col("l.text").rlike(BARE_WHOLE) & F.trim("o.text").rlike(SHORT_FRAGMENT) & column & height
    hit = _sided(lines, "l").join(_sided(fragments, "o"), (F.col(f"l.{page}") == F.col(f"o.{page}")) & test).groupBy(F.col(f"l.{page}").alias(page), F.col("l.line_id").alias("line_id")).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    return lines.join(hit, [page, "line_id"], "left_anti")


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], allowed: Callable[[g.Rect, g.Rect], Column], cost: Callable[[g.Rect, g.Rect], Column], most: int = 1, per: str = "l") -> DataFrame:
    """Pairs (l.*, o.* with a prefix o_, cost, rank) that are allowed, the `most` cheapest for each line of side `per`.

    Ties are taken by the other side's line_id. The ranking is a window over the line's own pairs, so Spark keeps no more
    than `most` rows for each line before the shuffle (WindowGroupLimit).
    """
    a, b = _sided(left, "l"), _sided(right, "o")
    same = [F.col(f"l.{c}") == F.col(f"o.{c}") for c in on]
    test = allowed(g.Rect.of("l"), g.Rect.of("o"))
    for s in same:
        test = s & test
    pairs = a.join(b, test).select("l.*", *[F.col(f"o.{c}").alias(f"o_{c}") for c in right.columns if c not in on], cost(g.Rect.of("l"), g.Rect.of("o")).alias("cost"))
    own, other = ("line_id", "o_line_id") if per == "l" else ("o_line_id", "line_id")
    w = Window.partitionBy(*on, own).orderBy("cost", other)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def right_lane(a: g.Rect, b: g.Rect) -> Column:
    """Upper and lower deviations of a horizontal dimension stand in the lane to its right."""
    gap = b.x0 - a.x1
    above = F.greatest(a.y0 - b.y1, b.y0 - a.y1, F.lit(0.0))
    return gap.between(-F.greatest(F.lit(4.0), a.width * 0.18), F.greatest(F.lit(40.0), a.width * 1.45)) & (above <= F.greatest(F.lit(28.0), a.height * 2.4))


def right_lane_cost(a: g.Rect, b: g.Rect) -> Column:
    above = F.greatest(a.y0 - b.y1, b.y0 - a.y1, F.lit(0.0))
    return F.greatest(b.x0 - a.x1, F.lit(0.0)) + above * 0.35


def behind(a: g.Rect, b: g.Rect) -> Column:
    """A deviation (a) right behind, before or beside its owner (b), for horizontal text."""
    across = F.abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2)
    reach = F.greatest(F.lit(12.0), F.greatest(b.height, F.lit(1.0)) * 1.5)
    after = (a.x0 - b.x1).between(-6.0, 56.0) & (across <= reach)
    before = (b.x0 - a.x1).between(-6.0, 56.0) & (across <= reach)
    beside = (F.least(a.x1, b.x1) > F.greatest(a.x0, b.x0)) & across.between(1.5, 30.0)
    return after | before | beside


def behind_cost(a: g.Rect, b: g.Rect) -> Column:
    """Behind and before come first, by their gap; then beside, by the distance across."""
    across = F.abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2)
    reach = F.greatest(F.lit(12.0), F.greatest(b.height, F.lit(1.0)) * 1.5)
    after, before = a.x0 - b.x1, b.x0 - a.x1
    return F.when(after.between(-6.0, 56.0) & (across <= reach), after).when(before.between(-6.0, 56.0) & (across <= reach), before).otherwise(1000.0 + across)


def line_support(lines: DataFrame, segments: DataFrame, page: str = "page_key") -> DataFrame:
    """lines with line_score: 0.5 without a parallel segment close by, 0.74 with one, 0.95 with more."""
    a = g.Rect.of("l")
    horizontal = a.width >= a.height
    length, thick = F.when(horizontal, a.width).otherwise(a.height), F.when(horizontal, a.height).otherwise(a.width)
    reach, side = F.greatest(F.lit(20.0), length * 2.2), F.greatest(F.lit(12.0), thick * 3.2)
    s = g.Rect.of("s")
    flat = F.col("s.horizontal") & (F.abs(s.y0 - (a.y0 + a.y1) / 2) <= side) & (s.x1 >= a.x0 - reach) & (s.x0 <= a.x1 + reach)
    tall = ~F.col("s.horizontal") & (F.abs(s.x0 - (a.x0 + a.x1) / 2) <= side) & (s.y1 >= a.y0 - reach) & (s.y0 <= a.y1 + reach)
    near = F.col("s.horizontal").eqNullSafe(horizontal) & (flat | tall)
    counted = lines.alias("l").join(segments.alias("s"), (F.col(f"l.{page}") == F.col(f"s.{page}")) & near, "left").groupBy(*[F.col(f"l.{c}").alias(c) for c in lines.columns]).agg(F.count("s.horizontal").alias("n_segments"))
    return counted.withColumn("line_score", F.when(F.col("n_segments") == 0, 0.5).when(F.col("n_segments") == 1, 0.74).otherwise(0.95))


def first_of(lines: DataFrame, key: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first line of each key, in the given order."""
    return lines.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def evidence_complete(candidates: DataFrame, callouts: DataFrame, page: str = "page_key") -> DataFrame:
    """(page, n_candidates, n_trusted, complete): at least four candidates, three of them under a callout read with .90 or more."""
    trusted = keep_where(candidates, callouts.where("score >= 0.9"), lambda a, b: g.share_of_smaller(a, b) >= 0.45, page).groupBy(page).agg(F.count("*").alias("n_trusted"))
    total = candidates.groupBy(page).agg(F.count("*").alias("n_candidates"))
    out = total.join(trusted, page, "left").withColumn("n_trusted", F.coalesce("n_trusted", F.lit(0).cast("long")))
    return out.withColumn("complete", (F.col("n_candidates") >= 4) & (F.col("n_trusted") >= 3))


def text_at(points: DataFrame, lines: DataFrame, slop: float = 5.0, page: str = "page_key") -> DataFrame:
    """The line nearest to each point within the slop; the smaller of equals, then by line_id."""
    r = g.Rect.of("l")
    far = g.point_distance(F.col("p.px"), F.col("p.py"), r)
    near = points.alias("p").join(lines.alias("l"), (F.col(f"p.{page}") == F.col(f"l.{page}")) & r.grown(slop).holds(F.col("p.px"), F.col("p.py")) & (far <= slop))
    best = F.min(F.struct(far.alias("far"), r.area.alias("area"), F.col("l.line_id").alias("line_id"), F.col("l.text").alias("text"))).alias("m")
    return near.groupBy(F.col("p.point_id").alias("point_id"), F.col(f"p.{page}").alias(page)).agg(best).select("point_id", page, "m.line_id", "m.text", F.col("m.far").alias("distance"))


def recovered_fits(lines: DataFrame, page: str = "page_key") -> DataFrame:
    """lines with `fit` and `fit_nominal` where a column of text such as φ2696 is φ26g6 read wrongly.

    That is so only with the deviations of a fit right beside it, since 2696 may be a number.
    """
    a, b = g.Rect.of("l"), g.Rect.of("o")
    pattern = r"^([φΦØ⌀])(\d+(?:[.,]\d+)?)96$"
    tall = a.height / F.greatest(a.width, F.lit(1e-6)) >= 1.6
    beside = (F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0) > -4.0) & (b.x0 - a.x1).between(-4.0, 34.0)
    known = lines.where(F.col("text").rlike(pattern)).alias("l").where(tall).join(lines.where(is_fit_deviation(F.col("text"))).alias("o"), (F.col(f"l.{page}") == F.col(f"o.{page}")) & not_same() & beside, "left_semi")
    number = F.regexp_extract("text", pattern, 2)
    fits = known.select(page, "line_id", F.concat(F.regexp_extract("text", pattern, 1), number, F.lit("G6")).alias("fit"), F.replace(number, F.lit(","), F.lit(".")).cast("double").alias("fit_nominal"))
    return lines.join(fits, [page, "line_id"], "left")


def over_fills(marks: DataFrame, fills: DataFrame, page: str = "page_key") -> DataFrame:
    """The marks (with a rectangle) that touch a filled polygon (points): a corner or the middle lies in it, or one of its points in the mark."""
    r = g.Rect.of("m")
    spots = [(r.x0, r.y0), (r.x1, r.y0), (r.x1, r.y1), (r.x0, r.y1), ((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2)]
    touched = F.exists("f.points", lambda p: r.holds(p.x, p.y))
    for x, y in spots:
        touched = touched | g.in_polygon(x, y, F.col("f.points"))
    return marks.alias("m").join(fills.alias("f"), (F.col(f"m.{page}") == F.col(f"f.{page}")) & touched, "left_semi")


def first_regions(regions: DataFrame, most: int = 4, page: str = "page_key") -> DataFrame:
    """The regions of a page that are read again first: those in focus, then small ones, then from the top, then from the left."""
    order = Window.partitionBy(page).orderBy(F.desc("focus"), F.desc("small"), "y0", "x0", "line_id")
    return regions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def first_segments(segments: DataFrame, most: int = 700, page: str = "page_key") -> DataFrame:
    """The first segments of a page, in order of line_id: what its structure is scored by, bounded."""
    return segments.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy("line_id"))).where(F.col("rank") <= most)
