"""Drawing text, tolerances, predicates and reconciliation on literal cases."""

from __future__ import annotations

import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from calibra.functions import geometry as g
from calibra.functions import text as tx
from calibra.functions import tolerance as tol
from calibra.operators import consensus, evaluate, groups, predicates, session, spatial
from calibra.operators.consensus import Reading

NORMAL = {
    "RO.5": "R0.5", "12,O5": "12.05", "45 MIN": "45", "Ω13.7±0.02": "Φ13.7±0.02", ".013.7±0.02": "13.7±0.02", "R0.2±01": "R0.2±0.1",
    "2.8+01": "2.8+0.1", "φ16H7+0018": "Φ16H7+0.018", "16H7+0.018": "16H7+0.018", "5.7+0.05": "5.7+0.05", "0)12士0.05": "Φ12±0.05", "$7.9±0.05": "7.9±0.05",
    "0.5-0.1": "0.5-0.1", "C0.2以下": "C0.2以下", "＠１２": "Φ12",
}


def column(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_normal_forms(spark):
    got = dict(column(spark, [(t,) for t in NORMAL], "t string", "t", tx.normalize(tx.nfkc("t"))))
    assert got == NORMAL
    assert column(spark, [(None,)], "t string", tx.normalize(tx.nfkc("t"))) == [(None,)]


def test_both_ways_to_normalize_agree(spark):
    rng = random.Random(3)
    texts = list(NORMAL) + ["".join(rng.choice("φΩCRcrMO0o12.,-−士±+。、)( 以下MAXmin$ー") for _ in range(rng.randrange(12))) for _ in range(3000)]
    got = column(spark, [(t,) for t in texts], "t string", "t", tx.normalize(F.col("t")))
    assert [(t, n) for t, n in got if n != tx.normalize_text(t)] == []


def test_fragments_and_tokens(spark):
    cases = {"05": True, "0.05": True, ".05": True, "±0.1": True, "6.2": False, "50.6±0.05": False}
    assert dict(column(spark, [(t,) for t in cases], "t string", "t", tx.is_fragment(tx.normalize(F.col("t"))))) == cases
    tokens = dict(column(spark, [(t,) for t in ("φ1O", "45 MIN", "(026.5)", "05", "SCALE 1:1", "60°")], "t string", "t", tx.token(F.col("t"))))
    assert tokens["φ1O"].nominal == 10.0 and tokens["45 MIN"].nominal == 45.0 and tokens["60°"].degree == "°"
    assert (tokens["(026.5)"].nominal, tokens["(026.5)"].reference) == (26.5, True)
    assert tokens["05"] is None and tokens["SCALE 1:1"] is None


JIS = [
    (0.03, "m", "linear", 0.03), (0.05, "m", "chamfer", 0.05), (0.099, "m", "radius", 0.099), (0.1, "m", "linear", 0.1), (0.1001, "m", "chamfer", 0.1), (0.49, "m", "linear", 0.1), (3, "f", "linear", 0.05),
    (3.01, "f", "linear", 0.05), (6.01, "m", "linear", 0.2), (2000.01, "m", "linear", 2.0), (3, "m", "chamfer", 0.2), (0.49, "m", "chamfer", 0.1), (0.5, "m", "chamfer", 0.2), (3.01, "f", "radius", 0.5), (0, "m", "linear", None), (4000.5, "m", "linear", None), (2500, "f", "linear", None),
    (0.09, "pisco", "linear", None), (0.5, "pisco", "diameter", 0.025), (0.51, "pisco", "diameter", 0.05), (6.01, "pisco", "linear", 0.2), (0.15, "pisco", "chamfer", 0.05), (0.05, "pisco", "chamfer", 0.05), (0.16, "pisco", "radius", 0.1),
]


def test_general_tolerances(spark):
    for standard in ("f", "m", "pisco"):
        rows = [(float(n), k, t) for n, s, k, t in JIS if s == standard]
        got = column(spark, rows, "n double, k string, want double", tol.general(F.col("n"), standard, F.col("k")), "want")
        assert all(a == b for a, b in got), got
    with pytest.raises(ValueError):
        tol.general(F.lit(1.0), "x", F.lit("linear"))


def test_tolerance_never_falls_as_the_size_grows(spark):
    rows = [(0.5 + k * 0.75,) for k in range(5000)]
    for standard in ("f", "m", "pisco"):
        got = [t for (t,) in column(spark, rows, "n double", tol.general(F.col("n"), standard, F.lit("linear"))) if t is not None]
        assert got == sorted(got)


def test_angles_notes_and_ranges(spark):
    sides = [(10.0, 1.0, "±1°"), (10.01, 0.5, "±30′"), (50.01, 20 / 60, "±20′"), (120.01, 10 / 60, "±10′"), (400.01, 5 / 60, "±5′")]
    assert all((v, t) == (w, x) for v, t, w, x in column(spark, sides, "s double, v double, t string", *tol.angle(F.col("s")), "v", "t"))
    text = "指示無き角度公差は ±1° とする\n指示無き角部はC0.1以下とする\n指示無き隅はR0.1以下とする"
    (note,), = column(spark, [(text,)], "t string", tx.notes(F.col("t")))
    assert (note.angle_value, note.angle_text, note.unindicated_chamfer_maximum, note.unindicated_radius_maximum, note.chamfer_tolerance, note.radius_tolerance) == (1.0, "±1°", 0.1, 0.1, None, None)
    (note,), = column(spark, [("指示無きC/R公差は±0.05とする",)], "t string", tx.notes(F.col("t")))
    assert (note.chamfer_tolerance, note.radius_tolerance) == (0.05, 0.05)
    ranges = [("φ26g6(-0.007 -0.020)", 26.0, 0.013), ("2.8+0.1", 2.8, 0.1), ("Φ16H7+0.018", 16.0, 0.018), ("50.6±0.05", 50.6, 0.1), ("12", 12.0, None), ("424-/A-C2", 424.0, None), ("3 5±0.2", 5.0, 0.4), ("7", 8.0, None)]
    assert all((a is None and b is None) or a == pytest.approx(b) for a, b in column(spark, ranges, "t string, n double, w double", tol.explicit_range(F.col("t"), F.col("n")), "w"))
    (width,), = column(spark, [("φ16H7", 16.0)], "t string, n double", tol.explicit_range(F.col("t"), F.col("n")))
    assert width == pytest.approx(16.0 * (0.45 * 16 ** (1 / 3) + 0.016) / 1000)


def test_colours(spark):
    rows = [("linear", 0.03, tol.PINK), ("linear", 0.0301, tol.YELLOW), ("angle", 1.0, tol.PINK), ("roughness", 5.8, tol.YELLOW), ("geometric", 0.01, tol.YELLOW), ("linear", None, tol.YELLOW)]
    assert all(a == b for a, b in column(spark, rows, "k string, r double, w string", tol.highlight(F.col("k"), F.col("r")), "w"))


def test_reject_reasons(spark):
    rows = [("linear", "", 12.0, "12", 0.9, None), ("linear", "", 12.0, "12", 0.5, "low_confidence"), ("linear", "", 600.0, "600", 0.9, "bare_too_large"), ("linear", "", 90.0, "90", 0.9, "bare_angle"), ("diameter", "φ", 81.0, "Φ81", 0.9, "diameter_too_large"), ("linear", "", 18.0, "018", 0.9, "leading_zero"), ("linear", "", 0.05, "0.05", 0.9, "fragment")]
    got = column(spark, rows, "k string, p string, n double, t string, s double, w string", predicates.reject_reason(F.col("k"), F.col("p"), F.lit(""), F.col("n"), F.col("t"), F.col("s"), F.lit(1)), "w")
    assert all(a == b for a, b in got), got


def test_rectangles_that_touch_do_not_meet(spark):
    a, b = g.Rect(*map(F.lit, (0.0, 0.0, 10.0, 10.0))), g.Rect(*map(F.lit, (10.0, 0.0, 20.0, 10.0)))
    c = g.Rect(*map(F.lit, (5.0, 5.0, 9.0, 9.0)))
    assert tuple(spark.range(1).select(g.meet(a, b), g.meet(a, c), g.share_of_smaller(a, c), g.share_of_smaller(a, b)).first()) == (False, True, 1.0, 0.0)


def r(k, text, score, *rect, **more):
    return Reading(k, text, float(score), *map(float, rect), **more)


def test_fragments_join():
    down = {"dx": 0.0, "dy": 1.0}
    assert [x.text for x in consensus.join_fragments([r(1, "Φ16.05", 0.95, 10, 10, 18, 60, **down), r(2, "+0.05", 0.98, 10, 62, 18, 90, **down)])] == ["Φ16.05+0.05"]
    assert sorted(x.text for x in consensus.join_fragments([r(1, "2.5+", 0.9, 30, 30, 50, 40), r(2, "0", 0.99, 52, 30, 58, 40)])) == ["0", "2.5+"]
    seam = [r(1, "2.", 0.95, 30, 50, 42, 60), r(2, "+0.25", 0.99, 48, 50, 70, 58), r(3, "2.5+", 0.9, 28, 48, 50, 62)]
    texts = [x.text for x in consensus.join_fragments(seam)]
    assert "2.5+0.25" in texts and "2.+0.25" not in texts
    texts = [x.text for x in consensus.join_fragments([*seam, r(4, "R0.2", 0.99, 55, 48, 78, 60)])]
    assert "2.5+0.25" in texts and not any(t.startswith("R0.2+") for t in texts)


def test_readings_merge():
    same = [r(1, "12.5", 0.8, 0, 0, 10, 10), r(2, "12.5", 0.9, 5, 0, 15, 10), r(3, "47.85", 0.9, 100, 0, 110, 10), r(4, "7.85", 0.95, 101, 0, 111, 10), r(5, "C0.15", 0.9, 200, 0, 210, 10), r(6, "0.15±0.02", 0.8, 202, 0, 212, 10)]
    ranks = {"12.5": 3, "47.85": 4, "7.85": 3, "C0.15": 4, "0.15±0.02": 8}  # as predicates.reading_quality gives them
    got = consensus.merge_readings([replace(x, quality=ranks[x.text]) for x in same])
    assert [(x.line_id, x.text, x.agreement) for x in got] == [(2, "12.5", 2), (3, "47.85", 1), (6, "0.15±0.02", 2)]


def test_candidates_and_bands():
    two = [r(1, "12", 0.9, 0, 0, 10, 10, nominal=12.0), r(2, "φ12", 0.9, 8, 0, 18, 10, nominal=12.0), r(3, "12", 0.9, 200, 0, 210, 10, nominal=12.0)]
    assert [x.line_id for x in consensus.dedupe_candidates(two)] == [2, 3]
    assert [x.line_id for x in consensus.merge_candidates([r(1, "12", 0.9, 0, 0, 10, 10), r(2, "12", 0.9, 1, 0, 11, 10)])] == [2]


def test_candidates_just_24_apart_both_stay():
    # the centres are 24 apart, and 23.999999999999996 if all edges are added up before they are halved
    two = [r(1, "12", 0.9, 24.0, 0, 40.4, 8, nominal=2.0), r(2, "12", 0.9, 0.0, 0, 16.400000000000006, 8, nominal=2.0)]
    assert [x.line_id for x in consensus.dedupe_candidates(two)] == [2, 1]
    assert [x.line_id for x in consensus.dedupe_candidates([two[0], replace(two[1], x1=16.5)])] == [1]


def test_detail_lines_just_8_apart_both_stay():
    # the centres are 8 apart, and 7.999999999999998 if all edges are added up before they are halved
    two = [r(1, "13", 0.9, 9.0, 0, 23.2, 8), r(2, "12", 0.9, 0.0, 0, 16.200000000000003, 8)]
    assert [x.line_id for x in consensus.detail_lines(two)] == [1, 2]
    assert [x.line_id for x in consensus.detail_lines([two[0], replace(two[1], x1=16.3)])] == [1]


def strips(spark, rows):
    """rows: readings on page 1."""
    return spark.createDataFrame([(1, *(getattr(x, c) for c in consensus.COLUMNS[1:])) for x in rows], consensus.SCHEMA)


def test_bands(spark):
    flat = [r(1, "#ffff00", 1, 0, 0, 20, 8), r(2, "#ffff00", 1, 24, 0, 30, 8), r(3, "#ff33cc", 1, 24, 0, 30, 8), r(4, "#ffff00", 1, 0, 40, 20, 48)]
    got = {x.line_id: (x.x0, x.x1, x.agreement) for x in groups.bands(strips(spark, flat)).collect()}
    assert got == {1: (0, 30, 2), 3: (24, 30, 1), 4: (0, 20, 1)}
    down = [r(x.line_id, x.text, 1, x.y0, x.x0, x.y1, x.x1, dx=0.0, dy=1.0) for x in flat]
    assert {x.line_id: (x.y0, x.y1, x.agreement) for x in groups.bands(strips(spark, down)).collect()} == got
    # strips that run down don't run on to the side, limits keep their own, and two whole strips stay two
    beside = [r(1, "c", 1, 0, 0, 8, 20, dx=0.0, dy=1.0), r(2, "c", 1, 12, 0, 20, 20, dx=0.0, dy=1.0), r(3, "c", 1, 100, 0, 120, 8, kind="limit"), r(4, "c", 1, 122, 0, 130, 8), r(5, "c", 1, 200, 0, 240, 8), r(6, "c", 1, 241, 0, 280, 8)]
    assert groups.bands(strips(spark, beside)).count() == 6


def test_strips_beside_get_one_thickness(spark):
    two = [r(1, "c", 1, 0, 0, 30, 6), r(2, "c", 1, 5, 10, 25, 20), r(3, "c", 1, 200, 0, 220, 6), r(4, "d", 1, 0, 10, 30, 14)]
    got = {x.line_id: (x.x0, x.y0, x.x1, x.y1) for x in groups.as_thick(strips(spark, two)).collect()}
    assert got == {1: (-0.2, -1.0, 30.2, 7.0), 2: (4.8, 11.0, 25.2, 19.0), 3: (200.0, 0.0, 220.0, 6.0), 4: (0.0, 10.0, 30.0, 14.0)}


def brute_callout(a, b):
    d = ((a.x0 + a.x1 - b.x0 - b.x1) ** 2 / 4 + (a.y0 + a.y1 - b.y0 - b.y1) ** 2 / 4) ** 0.5
    return d <= 30 and (consensus.shared(a, b) > 0.15 or a.text in b.text or b.text in a.text)


def test_groups_are_the_closure_of_their_edges(spark):
    rng, rows, want = random.Random(8), [], {}
    for page in range(40):
        lines = [r(k, rng.choice(["12", "12.5", "φ12", "5"]), 0.9, x := rng.randrange(60), y := rng.randrange(60), x + 10, y + 8, nominal=12.0) for k in range(rng.randrange(1, 9))]
        root = {x.line_id: x.line_id for x in lines}
        for _ in lines:
            for a, b in itertools.permutations(lines, 2):
                if brute_callout(a, b):
                    root[a.line_id] = root[b.line_id] = min(root[a.line_id], root[b.line_id])
        want |= {(page, k): v for k, v in root.items()}
        rows += [(page, *(getattr(x, c) for c in consensus.COLUMNS[1:])) for x in lines]
    df = spark.createDataFrame(rows, consensus.SCHEMA)
    assert {(x.page_key, x.line_id): x.group for x in groups.grouped(df, groups.callout()).collect()} == want
    assert groups.grouped(df.limit(0), groups.callout()).count() == 0


def test_limits_and_fits_group_by_their_own_rules(spark):
    rows = [r(1, "R0.2以下", 1, 0, 0, 10, 8, kind="limit", nominal=0.2), r(2, "R0.2", 1, 0, 0, 10, 8, kind="radius", nominal=0.2), r(3, "R0.2以下", 1, 5, 0, 15, 8, kind="limit", nominal=0.2), r(4, "φ24H7", 1, 100, 0, 110, 8, kind="diameter", nominal=24.0), r(5, "x24", 1, 120, 0, 130, 8, nominal=24.0), r(6, "y24", 1, 145, 0, 155, 8, nominal=24.0)]
    assert {x.line_id: x.group for x in groups.grouped(strips(spark, rows), groups.callout()).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6}


def pairs(spark, test, one, *others):
    """Which of the others the test holds for: (text, nominal, x0, y0, x1, y1)."""
    schema = "page_key long, line_id int, text string, nominal double, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame([(1, k, t, n, *map(float, box)) for k, (t, n, *box) in enumerate((one, *others))], schema)
    hits = df.where("line_id = 0").alias("l").join(df.where("line_id > 0").alias("o"), test(g.Rect.of("l"), g.Rect.of("o")))
    return sorted(x[0] - 1 for x in hits.select("o.line_id").collect())


def test_a_whole_number_echoes_the_digits_of_a_richer_text(spark):
    rich = [("φ20.5±0.1", 20.5, 2, 0, 30, 8), ("φ21.5±0.1", 21.5, 2, 0, 30, 8), ("φ20.5±0.1", 20.5, 60, 0, 90, 8)]
    assert pairs(spark, spatial.digit_echo, ("20", 20.0, 0, 0, 10, 8), *rich) == [0]
    assert pairs(spark, spatial.digit_echo, ("020", 20.0, 0, 0, 10, 8), *rich) == [0]
    for text in ("φ20", "20°", "20.0", "20,0"):
        assert pairs(spark, spatial.digit_echo, (text, 20.0, 0, 0, 10, 8), *rich) == []


def test_a_tolerance_is_attached_in_the_height_of_its_size(spark):
    size = ("20", 20.0, 0, 0, 10, 8)
    assert pairs(spark, spatial.tolerance_attached, size, ("±0.1", 0.0, 12, 1, 30, 9)) == [0]
    assert pairs(spark, spatial.tolerance_attached, size, ("±0.1", 0.0, 50, 1, 70, 9)) == []
    # in the same column below, but without a common height
    assert pairs(spark, spatial.tolerance_attached, size, ("±0.1", 0.0, 0, 10, 10, 18)) == []
    # far to the left, but at its lower edge and in its height
    assert pairs(spark, spatial.tolerance_attached, size, ("±0.1", 0.0, -60, 5, -40, 13)) == [0]


def test_a_tolerance_just_within_its_reach_is_attached(spark):
    # 10.8 - 0.35 * 8 is 8, but 8 - 10.8 is less than -0.35 * 8 by its rounding
    size = ("20", 20.0, 0, 0, 10.8, 8)
    assert pairs(spark, spatial.tolerance_attached, size, ("±0.1", 0.0, 8, 1, 30, 9), ("±0.1", 0.0, 7.9, 1, 30, 9)) == [0]


def test_a_stack_is_of_short_fragments_about_a_whole_number(spark):
    schema = "page_key long, line_id int, text string, x0 double, y0 double, x1 double, y1 double"

    def kept(*rows):
        df = spark.createDataFrame([(1, k, t, *map(float, box)) for k, (t, *box) in enumerate(rows)], schema)
        return sorted(x.line_id for x in spatial.stacked(df, df).collect())

    size = ("20", 0, 20, 10, 28)
    assert kept(size, ("+", 2, 5, 6, 10), ("0.1", 2, 40, 8, 46)) == [1, 2]
    assert kept(size, ("+", 2, 5, 6, 10), ("φ20.1", 2, 40, 8, 46)) == [0, 1, 2]
    assert kept(size, ("+", 2, 5, 6, 10), ("0.1", 40, 40, 48, 46)) == [0, 1, 2]
    assert kept(("φ20", 0, 20, 10, 28), ("+", 2, 5, 6, 10), ("0.1", 2, 40, 8, 46)) == [0, 1, 2]


def test_row_order_does_not_matter(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(5), k, rng.choice(["12", "12.5", "+0.1", "φ", "9"]), 0.9, float(x := rng.randrange(60)), float(y := rng.randrange(30)), x + 9.0, y + 8.0, 1.0, 0.0, 1, "linear", 12.0) for k in range(200)]
    out = []
    for _ in range(2):
        rng.shuffle(rows)
        out.append(sorted(map(tuple, consensus.by_page(spark.createDataFrame(rows, consensus.SCHEMA).repartition(7), consensus.join_fragments).collect())))
    assert out[0] == out[1] and consensus.by_page(spark.createDataFrame([], consensus.SCHEMA), consensus.append_strips).count() == 0


def test_scores_and_replay(spark):
    truth = spark.createDataFrame([("angle", 60.0), ("linear", 9.0), ("linear", 9.0)], "kind string, value double")
    found = spark.createDataFrame([("linear", 9.0), ("linear", 8.0)], "kind string, value double")
    assert tuple(evaluate.scores(truth, found, ["kind", "value"]).first()) == (1, 2, 2, 0.5, 0.5, 0.5)
    assert tuple(evaluate.scores(truth.limit(0), found.limit(0), ["kind", "value"]).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
    log = spark.createDataFrame([(1, k, u) for k, u in enumerate([False, False, True, False, True, True, True, False])], "user long, seq int, undo boolean")
    stack = []
    for k, u in enumerate([False, False, True, False, True, True, True, False]):
        if u:
            stack = stack[:-1]
        else:
            stack.append(k)
    assert [x.seq for x in session.undone(log, ["user"], "seq", "undo").collect()] == stack


def test_truth_names_of_angles(spark):
    truth = spark.createDataFrame([("a", "angle:60", ["60"]), ("b", "φ13.7±0.02", ["13.7±0.02"])], "name string, key string, aliases array<string>")
    found = spark.createDataFrame([("angle:60.0",), ("13.7±0.02",)], "text string")
    assert dict(map(tuple, evaluate.recall_by_alias(truth, found).collect())) == {"a": False, "b": True}  # the key is written without a decimal
