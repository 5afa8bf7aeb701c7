"""Which readings are no dimensions, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions.geometry import Rect
from calibra.functions.text import CONTEXT, EXPLICIT_TOLERANCE, LIMIT_CALLOUT, LIMIT_WORDS, PART_NUMBER, ROUGHNESS, ROUGHNESS_READ_AS_RANGE, THREAD, is_fragment

# Confidence floors.
FLOORS = {"page": 0.42, "tile": 0.34, "bare": 0.82, "scanned_bare": 0.68, "agreed": 0.58, "review": 0.72, "detail": 0.68, "crop": 0.64}


def no_dimension_context(text: Column) -> Column:
    return text.rlike(CONTEXT)


def reject_reason(kind: Column, prefix: Column, degree: Column, nominal: Column, compact: Column, score: Column, agreement: Column, floor: float = FLOORS["bare"], supplemental: bool = False) -> Column:
    """The first reason to reject a reading, or null. bare: neither prefix nor degree sign."""
    bare = (prefix == "") & (degree == "")
    least = F.when(agreement >= 2, FLOORS["agreed"]).otherwise(floor)
    out = (
        F.when(is_fragment(compact), "fragment").when(bare & (score < least), "low_confidence").when(bare & (nominal >= 500), "bare_too_large")
        .when(bare & nominal.isin(90.0, 180.0, 360.0), "bare_angle")
    )
    if supplemental:
        out = out.when(bare & (nominal >= 150), "supplemental_too_large")
    return (
        out.when((kind == "diameter") & (nominal > 80), "diameter_too_large").when((kind == "diameter") & (nominal < 1.0), "diameter_too_small")
        .when(bare & (nominal < 1.0), "bare_too_small").when(bare & compact.startswith("0") & ~compact.rlike("[.,]"), "leading_zero")
    )


def outside_drawing(r: Rect, width: Column, height: Column, bare_only: bool = False) -> Column:
    """Whether a rectangle lies in a title block, a revision column or beside zone letters."""
    x0, y0, x1, y1 = r.x0 / width, r.y0 / height, r.x1 / width, r.y1 / height
    out = (y1 < 0.10) | (y0 > 0.80) | ((x0 > 0.62) & (y0 > 0.68)) | ((x0 > 0.84) & (y1 < 0.50))
    if bare_only:
        out = out | (y1 < 0.15) | (y0 > 0.72) | ((x1 < 0.18) & (y0 > 0.30) & (y0 < 0.60))
    return out


def in_title_block(r: Rect, width: Column, height: Column, fit: Column) -> Column:
    """Readings that are dropped after merging: beyond .64 and .78 of the page, fits beyond .62 and .68."""
    return F.when(fit, (r.x0 > 0.62 * width) & (r.y0 > 0.68 * height)).otherwise((r.x0 > 0.64 * width) & (r.y0 > 0.78 * height))


def scanned_quality(score: Column, agreement: Column, line_support: Column, compact: Column, prefix: Column, degree: Column) -> Column:
    """A scanned reading's score with its supporting evidence, at most 1."""
    one = lambda c, by: F.when(c, by).otherwise(0.0)
    total = score + one(agreement >= 2, 0.12) + one(line_support, 0.10) + one(compact.rlike("[.,]"), 0.05) + one((prefix != "") | (degree != ""), 0.05)
    return F.least(F.lit(1.0), total)


def reading_quality(text: Column, score: Column) -> Column:
    """struct(quality, length, score): readings of one place, better ones greater."""
    one = lambda c, by: F.when(c, by).otherwise(0)
    digits = F.length(F.regexp_replace(F.regexp_extract(text, r"^[^±+\-]*", 0), r"\D", ""))
    q = one(text.contains("±"), 3) + one(text.rlike(r"±\d+\.\d+"), 2) - one(text.rlike(r"±\d{2,}(?:\D|$)"), 2) - one(text.rlike(r"±0$"), 3) + F.least(digits, F.lit(5)) + one(text.rlike(r"^[φΦØ⌀CR]"), 1)
    return F.struct(q.alias("quality"), F.length(text).alias("length"), score.alias("score"))


def candidate_quality(text: Column) -> Column:
    """Signs and degrees, and digits before a tolerance, of a candidate."""
    one = lambda c: F.when(c, 1).otherwise(0)
    digits = F.length(F.regexp_replace(F.regexp_extract(text, r"^[^±+\-]*", 0), r"\D", ""))
    return one(text.rlike(r"^[φΦØ⌀CR]")) + one(text.rlike("[°。]")) + F.least(digits, F.lit(5))


def plausible_tolerance(text: Column, nominal: Column, total: Column) -> Column:
    """Whether a reading with a total tolerance range may be a dimension that is coloured. text: NFKC, without spaces."""
    marked = text.rlike(r"(?i)[φΦØ⌀CR]")
    most = F.greatest(nominal * 0.6, F.least(F.lit(3.0), F.greatest(nominal, F.lit(0.5))))
    cut_off = (
        text.rlike(r"^\.|[.:,+\-±]$|±0$|[±+\-]0\.?$") | (text.rlike(r"^\d+[±+\-]") & ~F.regexp_replace(text, r"^[^±+\-]*[±+\-]", "").rlike(r"\d"))
        | text.rlike(r"^\d{1,2}[±+\-]\d$") | text.rlike(r"\d\.[±+\-]") | text.rlike(r"-\d+\.\d{3,}$")
    )
    stem = F.regexp_replace(text, "^[φΦØ⌀CRcr]", "")
    letters = stem.rlike("[A-Za-z]") & ~stem.rlike(r"^\d+(?:[.,]\d+)?[A-Za-z]\d{1,2}(?:[()（）±+\-－−].*)?$")
    other = text.rlike(r"[~〜～]") | text.rlike(ROUGHNESS_READ_AS_RANGE) | text.rlike(r"(?i)M\d") | text.rlike(PART_NUMBER) | (text.rlike(r"[A-Z]{2,}\d") & ~text.rlike("[±+]")) | (text.rlike(r"\+\d{2,}") & ~text.contains("±"))
    fits = (nominal > 0) & (nominal <= 4000) & (total > 0) & (total <= most) & (marked | (total <= nominal * 0.4))
    return F.coalesce(fits & ~(cut_off | letters | other), F.lit(False))


def limit_callout(text: Column) -> Column:
    """A callout such as C0.2以下, which is a limit of its own."""
    return text.rlike(LIMIT_CALLOUT)


def thread(text: Column) -> Column:
    return text.rlike(THREAD)


def roughness(text: Column) -> Column:
    return text.rlike(ROUGHNESS)


def view_label(prefix: Column, degree: Column, nominal: Column) -> Column:
    """A bare whole number under 4 on a scan, which names a view."""
    return (prefix == "") & (degree == "") & (nominal < 4) & (nominal == F.floor(nominal))


def text_size_fits(size: Column, expected: Column, marked: bool, decimal: Column, line_support: Column) -> Column:
    """Whether a text's size is near the page's: .82 to 1.23 of it for marked dimensions, else .74 to 1.13; decimals by a line from .56."""
    low, high = (0.82, 1.23) if marked else (0.74, 1.13)
    share = size / expected
    return (share >= F.when(decimal & line_support, 0.56).otherwise(low)) & (share <= high)


def marking_quality(text: Column, score: Column, structure: Column) -> Column:
    """struct(quality, length, score) of a toleranced reading; evidence of dimension lines only breaks ties."""
    one = lambda pattern, by: F.when(text.rlike(pattern), by).otherwise(0)
    digits = F.length(F.regexp_replace(F.regexp_extract(text, r"^[^±+\-－−士土]*", 0), r"\D", ""))
    q = one("[±士土]", 3) + one(r"[±士土]\d+\.\d+", 2) + one("^[φΦØ⌀]", 2) + one(r"[±士土]\d{2,}(?:\D|$)", -2) + one(r"(?i)^C\.\d", -1) + one(r"[±+\-]0\.?$|[±+\-]$", -4)
    return F.struct((q + F.least(digits, F.lit(5))).alias("quality"), F.length(text).alias("length"), (score + structure * 0.08).alias("score"))


def special_zone(kind: Column, bare: Column, nominal: Column, r: Rect, width: Column, height: Column, scanned: Column) -> Column:
    """Readings in places where numbers name something else: 60 and small bare numbers at the top right, diameters above them on scans."""
    sixty = (kind == "linear") & bare & (F.abs(nominal - 60.0) < 1e-9) & (r.y1 < 0.28 * height) & (r.x0 > 0.72 * width)
    margin = bare & (nominal < 100) & (r.x0 > 0.84 * width) & (r.y1 < 0.30 * height)
    return sixty | margin | (scanned & (kind == "diameter") & (r.y1 < 0.14 * height) & (r.x0 > 0.62 * width))


def scanned_floor(kind: Column, bare: Column, score: Column) -> Column:
    """Scores too low for a scan: bare lengths below .78, chamfers and radii below .75."""
    return ((kind == "linear") & bare & (score < 0.78)) | (kind.isin("chamfer", "radius") & (score < 0.75))


# Shares of the page where bare and prefixed sizes stand no more, the largest side, and the corner that only dimension lines make a drawing's.
LOWEST_BARE, LOWEST_PREFIXED, HIGHEST, LARGEST_SIDE, CORNER_WIDTH, CORNER_HEIGHT = 0.86, 0.93, 0.08, 85.0, 0.22, 0.32


def richer_evidence(text: Column) -> Column:
    """Whether a text (NFKC) says more than a nominal size: a tolerance written out, or a limit."""
    return text.rlike(EXPLICIT_TOLERANCE) | text.rlike(LIMIT_WORDS)


def off_limits(r: Rect, prefixed: Column, reference: Column, line_support: Column, width: Column, height: Column) -> Column:
    """Whether a candidate is too large, or stands in the page's margins: the top (but for reference sizes), the bottom, the upper left corner without a dimension line."""
    empty = (r.width <= 0) | (r.height <= 0)
    top, bottom = ~reference & (r.y1 < HIGHEST * height), r.y0 > F.when(prefixed, LOWEST_PREFIXED).otherwise(LOWEST_BARE) * height
    corner = (r.x1 < CORNER_WIDTH * width) & (r.y1 < CORNER_HEIGHT * height) & ~line_support
    return empty | top | bottom | (r.longer > LARGEST_SIDE) | corner


def page_routes(pages: DataFrame, words: DataFrame, images: DataFrame, recogniser: bool = True, page: str = "page_key") -> DataFrame:
    """(page, needs_recognition, scanned) of each page: by whether it holds words and images of its own.

    pages may have a column full_page_image. A page needs recognition if it has no words, and is scanned if one image
    fills it, or if it has images and no words.
    """
    have = lambda table, name: table.select(page).distinct().withColumn(name, F.lit(True))
    out = pages.join(have(words, "_words"), page, "left").join(have(images, "_images"), page, "left")
    silent, full = F.col("_words").isNull(), F.coalesce("full_page_image", F.lit(False)) if "full_page_image" in pages.columns else F.lit(False)
    return out.select(page, (silent & F.lit(recogniser)).alias("needs_recognition"), (full | (silent & F.col("_images").isNotNull())).alias("scanned"))
