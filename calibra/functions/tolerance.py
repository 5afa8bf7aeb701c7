"""General tolerances, fit widths, explicit ranges and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calibra.functions.text import PART_NUMBER, let

# Upper limits of the nominal size, each with its tolerance.
LINEAR = {
    "f": ((3, 0.05), (6, 0.05), (30, 0.1), (120, 0.15), (400, 0.2), (1000, 0.3), (2000, 0.5)),
    "m": ((3, 0.1), (6, 0.1), (30, 0.2), (120, 0.3), (400, 0.5), (1000, 0.8), (2000, 1.2), (4000, 2.0)),
}
CORNER = ((3, 0.2), (6, 0.5), (None, 1.0))
PISCO_CORNER = ((0.15, 0.05), (0.5, 0.1), (3, 0.2), (6, 0.5), (None, 1.0))
PISCO = {
    "diameter": ((0.5, 0.025), (3, 0.05), (6, 0.05), (30, 0.1), (120, 0.15), (400, 0.2), (1000, 0.3)),
    "linear": ((0.5, 0.05), (3, 0.1), (6, 0.1), (30, 0.2), (120, 0.3), (400, 0.5), (1000, 0.8)),
}
ANGLE = ((10, 1.0, "±1°"), (50, 0.5, "±30′"), (120, 20 / 60, "±20′"), (400, 10 / 60, "±10′"), (None, 5 / 60, "±5′"))
IT_FACTORS = (0.8, 1.2, 2.0, 3.0, 7.0, 10.0, 16.0, 25.0, 40.0, 64.0, 100.0, 160.0, 250.0, 400.0, 640.0, 1000.0, 1600.0, 2500.0)
YELLOW, PINK = "#ffff00", "#ff33cc"


def _first(value: Column, table: tuple) -> Column:
    """The entry of the first limit that the value doesn't exceed; null beyond the last."""
    out = F.lit(None).cast("double")
    for limit, entry, *_ in reversed(table):
        out = F.lit(entry) if limit is None else F.when(value <= limit, F.lit(entry)).otherwise(out)
    return out


def general(nominal: Column, standard: str, kind: Column) -> Column:
    """The general tolerance of a nominal size. standard: f or m (the JIS grades) or pisco."""
    corner = kind.isin("chamfer", "radius")
    if standard == "pisco":
        plain = F.when(nominal >= 0.1, F.when(kind == "diameter", _first(nominal, PISCO["diameter"])).otherwise(_first(nominal, PISCO["linear"])))
        return F.when(corner, _first(nominal, PISCO_CORNER)).otherwise(plain)
    if (grade := standard.lower()) not in LINEAR:
        raise ValueError(f"no such standard: {standard}")
    sized = F.when(corner, _first(nominal, CORNER)).otherwise(_first(nominal, LINEAR[grade]))
    return F.when(nominal <= 0, None).when(nominal <= 0.099, nominal).when(nominal < 0.5, 0.1).otherwise(sized)


def angle(short_side: Column) -> tuple[Column, Column]:
    """Tolerance in degrees and its text, by the length of the angle's shorter side."""
    text = F.lit(ANGLE[-1][2])
    for limit, _, label in reversed(ANGLE[:-1]):
        text = F.when(short_side <= limit, label).otherwise(text)
    return _first(short_side, ANGLE), text


def with_notes(nominal: Column, standard: str, kind: Column, chamfer_note: Column, radius_note: Column) -> Column:
    """general(), but what a page's notes say about chamfers and radii comes first."""
    table = general(nominal, standard, kind)
    return F.when(kind == "chamfer", F.coalesce(chamfer_note, table)).when(kind == "radius", F.coalesce(radius_note, table)).otherwise(table)


def fit_width(nominal: Column, grade: Column) -> Column:
    """Width of an ISO fit's zone in millimetres, by its grade of 1 to 18; null for others."""
    factor = F.get(F.array(*map(F.lit, IT_FACTORS)), grade.cast("int") - 1)
    return F.when(grade.between(1, len(IT_FACTORS)) & (nominal > 0), factor * (0.45 * F.pow(nominal, F.lit(1.0 / 3.0)) + 0.001 * nominal) / 1000.0)


def explicit_range(text: Column, nominal: Column) -> Column:
    """Total tolerance range written behind the nominal size in an NFKC text; null if there is none."""
    number = r"\d+(?:[.,]\d+)?"
    sizes = lambda t: F.transform(F.regexp_extract_all(t, F.lit(f"({number})"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))

    def written(tail: Column, found: Column) -> Column:
        first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        return (
            F.when(F.size(found) == 0, None).when(tail.contains("±"), first * 2).when(F.size(found) == 1, first)
            .when(tail.contains("+") & tail.contains("-"), F.abs(first) + F.abs(second)).otherwise(F.abs(F.array_max(found) - F.array_min(found)))
        )

    def behind(rest: Column) -> Column:
        """The range in what stands behind the nominal size: a fit, or deviations, or both."""
        grade = F.regexp_extract(rest, r"^\s*([A-Za-z])\s*(\d{1,2})", 2).try_cast("int")
        deviations = lambda tail: F.when(tail.rlike(r"^\s*[-/][A-Za-z]"), None).when(tail.rlike("[±+-]"), let(sizes(tail), lambda found: written(tail, found))).otherwise(fit_width(nominal, grade))
        return let(F.regexp_replace(rest, r"^\s*[A-Za-z]\s*\d{1,2}", ""), deviations)

    def at(plain: Column, which: Column) -> Column:
        # numbers are cut off from the front one by one, up to the nominal size
        rest = F.aggregate(F.sequence(F.lit(1), F.greatest(which, F.lit(1))), plain, lambda t, _: F.regexp_replace(t, rf"^\D*{number}", ""))
        return F.when((which > 0) & ~plain.rlike(PART_NUMBER), let(rest, behind))

    place = lambda plain: F.array_position(F.transform(sizes(plain), lambda x: F.abs(x - nominal) < 1e-7), True)
    return let(F.translate(text, "亇干土士−－", "±±±±--"), lambda plain: let(place(plain), lambda which: at(plain, which)))


def highlight(kind: Column, total_range: Column) -> Column:
    """Pink for tight ranges, yellow for others and for geometric tolerances."""
    limit = F.when(kind == "roughness", 5.7).when(kind == "angle", 1.0).otherwise(0.03)
    return F.when((kind != "geometric") & (total_range <= limit + 1e-9), PINK).otherwise(YELLOW)
