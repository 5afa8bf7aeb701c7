"""Quads, regions, label places, strips and log folds on literal cases."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibra.functions import geometry as g
from calibra.functions import text as tx
from calibra.operators import consensus, groups, layout, predicates, session, spatial
from calibra.operators.consensus import Reading

POINT = "struct<x:double,y:double>"


def quad(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


BOX = quad((0, 0), (10, 0), (10, 4), (0, 4))


def test_quads(spark):
    far = quad((20, 1), (30, 1), (30, 9), (20, 9))
    df = spark.createDataFrame([(BOX, far)], f"a array<{POINT}>, b array<{POINT}>")
    long = df.select(g.bounds(g.extended(F.col("a"), F.col("b"), F.lit(1.0), F.lit(0.0))).alias("r")).first().r
    assert tuple(long) == pytest.approx((-0.8, 0.0, 30.8, 4.0))
    thick = df.select(g.bounds(g.as_thick(F.col("a"), F.lit(1.0), F.lit(0.0), F.lit(1.0))).alias("r")).first().r
    assert tuple(thick) == pytest.approx((-0.6, 0.6, 10.6, 3.4))
    down = df.select(g.bounds(g.extended(F.col("a"), F.col("b"), F.lit(0.0), F.lit(1.0), 0.0)).alias("r")).first().r
    assert tuple(down) == pytest.approx((0.0, 0.0, 10.0, 9.0))
    near = quad((0.2, 0), (10, 0.3), (10, 4), (0, 4))
    same = spark.createDataFrame([(BOX, near, True), (BOX, far, False)], f"a array<{POINT}>, b array<{POINT}>, want boolean")
    assert all(r.got == r.want for r in same.withColumn("got", g.same_region(F.col("a"), F.col("b"))).collect())
    area, inside, outside = df.select(g.polygon_area(F.col("a")), g.in_polygon(F.lit(5.0), F.lit(2.0), F.col("a")), g.in_polygon(F.lit(15.0), F.lit(2.0), F.col("a"))).first()
    assert (area, inside, outside) == (40.0, True, False)


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=25), st.floats(0.1, 5))
@settings(max_examples=100, deadline=None)
def test_simplified_lines_stay_close(points, tolerance):
    got = g.simplified(points, tolerance)
    assert got[0] == points[0] and got[-1] == points[-1] and set(got) <= set(points)
    assert len(points) < 3 or g.simplified(points, 1000.0) == [points[0], points[-1]]


def test_simplify_column(spark):
    df = spark.createDataFrame([(quad((0, 0), (5, 0.1), (10, 0)),), ([],), (None,)], f"l array<{POINT}>")
    got = [r.s and [(p.x, p.y) for p in r.s] for r in df.select(g.simplify(1.0)("l").alias("s")).collect()]
    assert got == [[(0.0, 0.0), (10.0, 0.0)], [], None]


def test_labels_go_to_the_first_clean_place(spark):
    labels = spark.createDataFrame([(1, 1, 100.0, 100.0, 120.0, 108.0), (1, 2, 300.0, 100.0, 320.0, 108.0)], "page_key long, label_id int, x0 double, y0 double, x1 double, y1 double")
    taken = spark.createDataFrame([(1, 95.0, 80.0, 125.0, 109.0)], "page_key long, x0 double, y0 double, x1 double, y1 double")
    got = {r.label_id: (r.dx, r.dy, r.collisions) for r in layout.place_labels(labels, taken, 500.0, 500.0).collect()}
    assert got == {1: (0.0, 14.0, 0), 2: (0.0, 0.0, 0)}


def test_short_pink_joins_long_yellow(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 8.0, "p"), (1, 2, 12.0, 0.0, 60.0, 8.0, "y"), (1, 3, 0.0, 100.0, 10.0, 108.0, "p")]
    df = spark.createDataFrame(rows, "page_key long, line_id int, x0 double, y0 double, x1 double, y1 double, color string")
    assert {r.line_id: r.color for r in layout.absorb(df, "p", "y").collect()} == {1: "y", 2: "y", 3: "p"}


def r(k, text, *rect, **more):
    return Reading(k, text, 0.9, *map(float, rect), **more)


def test_strips_part_in_the_middle():
    a, b = layout.part_overlaps([r(1, "x", 0, 0, 20, 8), r(2, "x", 16, 0, 40, 8)])
    assert (a.x1, b.x0) == pytest.approx((17.4, 18.6))
    assert layout.part_overlaps([r(1, "x", 0, 0, 20, 8), r(2, "x", 30, 0, 40, 8)])[0].x1 == 20


def test_roughness_merges_and_nothing_else_does(spark):
    parts = [r(1, "Rz 6.3", 0, 0, 20, 8, kind="roughness", nominal=6.3), r(2, "6.3", 25, 1, 35, 9, kind="roughness", nominal=6.3), r(3, "6.3", 80, 0, 90, 8, kind="roughness", nominal=6.3)]
    lengths = [r(k + 10, "6.3", *box, nominal=6.3) for k, box in enumerate(((0, 0, 20, 8), (1, 1, 21, 9)))]
    df = spark.createDataFrame([(1, *(getattr(x, c) for c in consensus.COLUMNS[1:])) for x in [*parts, *lengths]], consensus.SCHEMA)
    got = sorted((x.line_id, x.x0, x.x1, x.agreement) for x in groups.merged_roughness(df).collect())
    assert got == [(1, 0.0, 35.0, 2), (3, 80.0, 90.0, 1), (10, 0.0, 20.0, 1), (11, 1.0, 21.0, 1)]


def test_markings_and_reads():
    marks = [r(1, "R0.2以下", 0, 0, 20, 8, kind="limit", nominal=0.2), r(2, "C0.2以下", 0, 2, 20, 10, kind="limit", nominal=0.2), r(3, "φ24.95g6", 100, 0, 140, 8, kind="diameter", nominal=24.95), r(4, "95g6", 120, 0, 140, 8, nominal=95.0), r(5, "12±0.1", 200, 0, 220, 8, nominal=12.0), r(6, "12", 205, 0, 220, 8, nominal=12.0)]
    assert [x.text for x in consensus.merge_markings(marks)] == ["R0.2以下", "C0.2以下", "φ24.95g6", "12±0.1"]
    small = consensus.merge_markings([r(1, "R0.2±0.1", 0, 4, 20, 10, kind="radius", nominal=0.2, quality=5), r(2, "R0.2", 2, 0, 24, 8, kind="radius", nominal=0.2)])
    assert [(x.x0, x.y0, x.x1, x.y1) for x in small] == [(-0.4, 0.0, 24.4, 10.0)]
    down = consensus.merge_markings([r(1, "12", 0, 0, 8, 20, nominal=12.0, dx=0.0, dy=1.0), r(2, "12", 1, 5, 10, 30, nominal=12.0, dx=0.0, dy=1.0)])
    assert [(x.x0, x.y0, x.x1, x.y1) for x in down] == [(0.0, -0.4, 8.0, 30.4)]
    reads = [r(1, "C02", 0, 0, 10, 8, nominal=0.2), r(2, "C0.2", 1, 0, 11, 8, nominal=0.2), r(5, "C0.3", 50, 0, 60, 8, nominal=0.3)]
    assert [x.text for x in consensus.independent_reads(reads, lambda x: x.line_id)] == ["C0.2"]


def test_plausible_markings(spark):
    rows = [("50.6±0.05", 50.6, 0.1, True), ("R0.2±01", 0.2, 2.0, False), ("12±0", 12.0, 0.0, False), ("12±0.", 12.0, 0.1, False), ("26g6±0.01", 26.0, 0.02, True), ("130E~±0.2", 130.0, 0.4, False), ("M6±0.1", 6.0, 0.2, False), ("424-/A-C2", 424.0, 1.0, False), ("5+12", 5.0, 1.0, False), ("10+0.02-0.01", 10.0, 0.03, True), ("7±0.1", 7.0, None, False)]
    df = spark.createDataFrame(rows, "t string, n double, r double, want boolean")
    got = df.withColumn("got", predicates.plausible_tolerance(F.col("t"), F.col("n"), F.col("r"))).collect()
    assert all(x.got == x.want for x in got), got


def test_fit_pieces_and_corners(spark):
    texts = {"(-0.007": True, "-0.020)": True, "+0.2": False, "12": False, "(": False}
    got = {x.t: x.d for x in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.is_fit_deviation(F.col("t")).alias("d")).collect()}
    assert got == texts
    codes = {x.t: x.c and tuple(x.c) for x in spark.createDataFrame([("C02",), ("r 12",), ("C.15",), ("12",)], "t string").select("t", tx.corner_code(F.col("t")).alias("c")).collect()}
    assert codes == {"C02": ("C", 0.2), "r 12": ("R", 12.0), "C.15": ("C", 15.0), "12": None}


def test_stack_belongs_to_its_owner(spark):
    schema = "page_key long, line_id int, text string, x0 double, y0 double, x1 double, y1 double"
    owner = spark.createDataFrame([(1, 1, "10", 80.0, 100.0, 100.0, 108.0)], schema)
    pieces = spark.createDataFrame([(1, 2, "+0.02", 103.0, 90.0, 132.0, 97.0), (1, 3, "-0.01", 103.0, 109.0, 132.0, 116.0), (1, 4, "+0.04", 180.0, 90.0, 209.0, 97.0)], schema)
    got = spatial.nearest(owner, pieces, ["page_key"], spatial.right_lane, spatial.right_lane_cost, most=2)
    assert {x.o_text for x in got.collect()} == {"+0.02", "-0.01"}


def test_removing_an_addition_takes_its_band(spark):
    add = spark.createDataFrame([(1, 0, 5, 0.0, 0.0, 10.0, 8.0), (1, 1, 5, 50.0, 0.0, 60.0, 8.0)], "batch_id int, ordinal int, page_key long, x0 double, y0 double, x1 double, y1 double")
    bands = spark.createDataFrame([(5, 1.0, 0.0, 9.0, 8.0), (5, 51.0, 0.0, 59.0, 8.0), (6, 1.0, 0.0, 9.0, 8.0)], "page_key long, x0 double, y0 double, x1 double, y1 double")
    left, strips = session.removed(add, bands, spark.createDataFrame([(1, 0)], "batch_id int, ordinal int"))
    assert [x.ordinal for x in left.collect()] == [1] and sorted((x.page_key, x.x0) for x in strips.collect()) == [(5, 51.0), (6, 1.0)]
