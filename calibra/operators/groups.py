"""Strips of a page that belong together: edges are rows of a join on conditions over columns, groups are what edges reach.

Strips are rows (page_key, line_id, text, score, x0, y0, x1, y1, dx, dy, agreement, kind, nominal); (dx, dy) is the
direction that a strip is read in. An edge joins two strips of a page, the one of the lower line_id as l, the other as o;
where a direction matters it is l's.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions import geometry as g

# Kinds that keep their own strips; distances in points, and shares of a thickness.
OWN_STRIPS = ("limit", "stacked_tolerance")
OWN_THICKNESS = ("limit", "stacked_tolerance", "general_descriptor")
CALLOUT_REACH, FIT_REACH, CALLOUT_SHARE = 30.0, 22.0, 0.15
BAND_COSINE, BAND_OVERLAP = 0.94, 0.4
ROUGHNESS_AREA, ROUGHNESS_GAP, ROUGHNESS_LANE = 0.2, 8.0, 0.35
BESIDE_OVERLAP, BESIDE_NEAR, BESIDE_FAR = 2.0, 3.5, 28.0
THINNEST = 2.8
FIT = r"\d(?:\.\d+)?[ \t]*[A-Za-z][ \t]?[0-9]{1,2}(?![0-9.])"


class Span(NamedTuple):
    """An interval of projections."""

    lo: Column
    hi: Column

    @property
    def middle(self) -> Column:
        return (self.lo + self.hi) / 2

    @property
    def size(self) -> Column:
        return self.hi - self.lo

    def overlap(self, other: Span) -> Column:
        """Below zero where a gap parts them."""
        return F.least(self.hi, other.hi) - F.greatest(self.lo, other.lo)


def along(r: g.Rect, dx: Column, dy: Column) -> Span:
    """The projection of a rectangle on a direction; across it, that is (-dy, dx), with the two turned."""
    sides = ((r.x0 * dx, r.x1 * dx), (r.y0 * dy, r.y1 * dy))
    return Span(F.least(*sides[0]) + F.least(*sides[1]), F.greatest(*sides[0]) + F.greatest(*sides[1]))


class Pair(NamedTuple):
    """The two strips of an edge, projected on the direction of l."""

    a: g.Rect
    b: g.Rect
    along: tuple[Span, Span]
    across: tuple[Span, Span]

    @classmethod
    def of(cls) -> Pair:
        a, b, dx, dy = g.Rect.of("l"), g.Rect.of("o"), F.col("l.dx"), F.col("l.dy")
        return cls(a, b, (along(a, dx, dy), along(b, dx, dy)), (along(a, -dy, dx), along(b, -dy, dx)))


def _equal(name: str) -> Column:
    return F.col(f"l.{name}") == F.col(f"o.{name}")


def _neither(kinds: tuple[str, ...]) -> Column:
    return ~F.col("l.kind").isin(*kinds) & ~F.col("o.kind").isin(*kinds)


def same_nominal() -> Column:
    return F.abs(F.col("l.nominal") - F.col("o.nominal")) <= 1e-6


def callout() -> Column:
    """Two readings are fragments of one callout: of one value and compatible kinds, close, and one over or part of the other, or a fit. Limits must be the same."""
    p, one, other = Pair.of(), F.col("l.text"), F.col("o.text")
    lengths = F.col("l.kind").isin("linear", "diameter") & F.col("o.kind").isin("linear", "diameter")
    limits = _neither(("limit",)) | (_equal("kind") & _equal("text"))
    distance = g.centre_distance(p.a, p.b)
    tied = (g.share_of_smaller(p.a, p.b) > CALLOUT_SHARE) | one.contains(other) | other.contains(one) | ((one.rlike(FIT) | other.rlike(FIT)) & (distance <= FIT_REACH))
    return limits & (_equal("kind") | lengths) & same_nominal() & (distance <= CALLOUT_REACH) & tied


def roughness() -> Column:
    """Two readings of one roughness: they share an area, or follow one another in a line or a column."""
    p = Pair.of()
    follows = lambda lane, way: (lane[0].overlap(lane[1]) > ROUGHNESS_LANE * F.least(lane[0].size, lane[1].size)) & (way[0].overlap(way[1]) >= -ROUGHNESS_GAP)
    return same_nominal() & ((g.shared_area(p.a, p.b) > ROUGHNESS_AREA) | follows(p.across, p.along) | follows(p.along, p.across))


def band() -> Column:
    """Two strips of one colour (kept in text) run on as one band."""
    p = Pair.of()
    (s, t), (u, v) = p.along, p.across
    thick = F.greatest((u.size + v.size) / 2, F.lit(2.4))
    off, over = F.abs(u.middle - v.middle), s.overlap(t)
    short, long = (pick(F.greatest(s.size, F.lit(1.0)), F.greatest(t.size, F.lit(1.0))) for pick in (F.least, F.greatest))
    one_way = F.abs(F.col("l.dx") * F.col("o.dx") + F.col("l.dy") * F.col("o.dy")) >= BAND_COSINE
    two_whole = (short > 3.5 * thick) & (short / long > 0.62)
    graze = (over > 0) & (over <= 0.16 * thick) & (off > 0.28 * thick)
    reached = (over > BAND_OVERLAP) | (-over <= F.greatest(F.lit(5.8), F.least(F.lit(9.5), 0.9 * thick)))
    return _equal("text") & _neither(OWN_STRIPS) & one_way & (off <= F.greatest(F.lit(5.2), 0.8 * thick)) & ~two_whole & ~graze & reached


def beside() -> Column:
    """Two strips of one colour (kept in text) run beside one another."""
    p = Pair.of()
    return _equal("text") & _neither(OWN_THICKNESS) & (p.along[0].overlap(p.along[1]) >= BESIDE_OVERLAP) & F.abs(p.across[0].middle - p.across[1].middle).between(BESIDE_NEAR, BESIDE_FAR)


def edges(strips: DataFrame, test: Column, page: str = "page_key") -> DataFrame:
    """(page, a, b): the pairs of a page's line_ids that the test holds for, a < b."""
    same_page = (F.col(f"l.{page}") == F.col(f"o.{page}")) & (F.col("l.line_id") < F.col("o.line_id"))
    return strips.alias("l").join(strips.alias("o"), same_page & test).select(F.col(f"l.{page}").alias(page), F.col("l.line_id").alias("a"), F.col("o.line_id").alias("b"))


def grouped(strips: DataFrame, test: Column, page: str = "page_key") -> DataFrame:
    """strips with a column group: the least line_id that edges reach from a strip. A row holds the line_ids of one page, nothing larger."""
    ids = strips.groupBy(page).agg(F.sort_array(F.collect_set("line_id")).alias("_ids"))
    links = edges(strips, test, page).groupBy(page).agg(F.collect_list(F.struct("a", "b")).alias("_links"))
    at = lambda roots, i: F.element_at(roots, F.array_position(F.col("_ids"), i).cast("int"))

    def joined(roots: Column, edge: Column) -> Column:
        one, other = at(roots, edge.a), at(roots, edge.b)
        return F.transform(roots, lambda r: F.when(r == F.greatest(one, other), F.least(one, other)).otherwise(r))

    roots = F.when(F.col("_links").isNull(), F.col("_ids")).otherwise(F.aggregate("_links", F.col("_ids"), joined))
    found = ids.join(links, page, "left").select(page, F.explode(F.arrays_zip(F.col("_ids").alias("line_id"), roots.alias("group"))).alias("_r"))
    return strips.join(found.select(page, F.col("_r.line_id").alias("line_id"), F.col("_r.group").alias("group")), [page, "line_id"])


def _whole() -> list[Column]:
    """What encloses a group, and its size."""
    return [F.min("x0").alias("_x0"), F.min("y0").alias("_y0"), F.max("x1").alias("_x1"), F.max("y1").alias("_y1"), F.count("*").cast("int").alias("_n")]


def _as(strips: DataFrame, rect: dict[str, Column]) -> DataFrame:
    """strips with other corners and with the size of their group in agreement, without the columns of the group."""
    out = strips.select(*[c for c in strips.columns if c not in rect and c != "agreement"], *[v.alias(k) for k, v in rect.items()], F.col("_n").alias("agreement"))
    return out.drop("group", "_x0", "_y0", "_x1", "_y1", "_n", "_base")


def bands(strips: DataFrame, page: str = "page_key") -> DataFrame:
    """One strip for each group of strips that run on: the first, around all of them. agreement: how many they are."""
    own = grouped(strips, band(), page)
    first = own.where(F.col("line_id") == F.col("group")).join(own.groupBy(page, "group").agg(*_whole()), [page, "group"])
    return _as(first, {c: F.col(f"_{c}") for c in ("x0", "y0", "x1", "y1")})


def merged_roughness(strips: DataFrame, page: str = "page_key") -> DataFrame:
    """Fragments of a roughness as one strip: the largest (of equals the first), as long as all of them in its direction, as thick as it was. Other kinds pass as they are."""
    rough = F.col("kind") == "roughness"
    own = grouped(strips.where(rough), roughness(), page)
    best = F.min_by("line_id", F.struct((-g.Rect.of().area).alias("area"), F.col("line_id"))).alias("_base")
    base = own.join(own.groupBy(page, "group").agg(best, *_whole()), [page, "group"]).where(F.col("line_id") == F.col("_base"))
    down = g.columnar(g.Rect.of(), F.col("dy"))
    out = _as(base, {c: F.when(down if c[0] == "y" else ~down, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("x0", "y0", "x1", "y1")})
    return out.unionByName(strips.where(~rough | F.col("kind").isNull()).select(out.columns))


def as_thick(strips: DataFrame, page: str = "page_key", by: float = 0.2) -> DataFrame:
    """Strips of one colour (kept in text) that run beside one another get one thickness: the mean of their group, about their own middle, and are `by` longer at either end. Strips run along or down the page."""
    own = grouped(strips, beside(), page)
    r, down = g.Rect.of(), F.abs(F.col("dy")) >= 0.72
    thickness = F.when(down, r.width).otherwise(r.height)
    out = own.join(own.groupBy(page, "group").agg(F.avg(thickness).alias("_t"), F.count("*").alias("_n")), [page, "group"])
    half, alone = F.greatest(F.col("_t"), F.lit(THINNEST)) / 2, F.col("_n") == 1

    def corner(name: str) -> Column:
        sign, middle = -1 if name[1] == "0" else 1, (r.x0 + r.x1) / 2 if name[0] == "x" else (r.y0 + r.y1) / 2
        thick, long = middle + sign * half, F.col(name) + sign * by
        return F.when(alone, F.col(name)).when(down if name[0] == "x" else ~down, thick).otherwise(long)

    corners = {c: corner(c) for c in ("x0", "y0", "x1", "y1")}
    return out.select(*[c for c in strips.columns if c not in corners], *[v.alias(k) for k, v in corners.items()])
