"""Text that a vector page holds itself: lines and spans out of a page's nested blocks.

blocks: array of structs (lines), lines of (bbox, dir, spans), spans of (bbox, size, font, color, origin, chars), chars of
(c); a bbox is an array of four numbers, dir and origin one of two, color 0xRRGGBB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = (
    "array<struct<lines:array<struct<bbox:array<double>,dir:array<double>,spans:array<struct<"
    "bbox:array<double>,size:double,font:string,color:int,origin:array<double>,chars:array<struct<c:string>>>>>>>>"
)
RECT = ("x0", "y0", "x1", "y1")
# The letters of a dimension, and how many there may be.
DIMENSION_TEXT, LONGEST = r"^[0-9０-９A-Za-zφΦØ∅⌀＋+\-−±°′″.,()（）/以下最大小]+$", 24


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(F.flatten(F.transform(spans, lambda s: F.coalesce(s.chars, F.array()))), lambda c: F.coalesce(c.c, F.lit(""))), "")


def _corners(box: Column) -> list[Column]:
    return [F.get(box, F.lit(k)).alias(c) for k, c in enumerate(RECT)]


def _channels(color: Column) -> Column:
    return F.transform(F.array(*[F.lit(k) for k in (16, 8, 0)]), lambda k: F.call_function("shiftright", F.coalesce(color, F.lit(0)), k).bitwiseAND(F.lit(255)) / 255.0)


def _lines(pages: DataFrame, page: str) -> DataFrame:
    return pages.select(page, F.posexplode("blocks").alias("b", "block")).select(page, "b", F.posexplode("block.lines").alias("n", "line"))


def text_lines(pages: DataFrame, page: str = "page_key") -> DataFrame:
    """(page, b, n, text, size, raw_size, x0, y0, x1, y1, dx, dy, origin_x, origin_y, font, color) of the lines with an area, by block and line.

    size is the largest of the spans that show something, raw_size of all; font, color and origin are those of the first
    span of that size, and without one empty, black, and the lower left corner. (dx, dy) has a length of 1. A page without
    blocks, a block without lines and a line without spans are no error.
    """
    lines = _lines(pages, page).select(page, "b", "n", "line", *_corners(F.col("line.bbox")))
    lines = lines.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).withColumn("spans", F.coalesce("line.spans", F.array().cast(lines.schema["line"].dataType["spans"].dataType)))
    shown = F.filter("spans", lambda s: F.exists(F.coalesce(s.chars, F.array()), lambda c: F.trim(c.c) != ""))
    size = lambda spans: F.coalesce(F.array_max(F.transform(spans, lambda s: F.coalesce(s.size, F.lit(0.0)))), F.lit(0.0))
    lines = lines.withColumn("shown", shown).withColumn("size", size(F.col("shown"))).withColumn("raw_size", size(F.col("spans")))
    first = F.get(F.filter("shown", lambda s: F.coalesce(s.size, F.lit(0.0)) == F.col("size")), F.lit(0))
    ways = [F.coalesce(F.get("line.dir", F.lit(k)), F.lit(v)) for k, v in enumerate((1.0, 0.0))]
    length = F.sqrt(ways[0] * ways[0] + ways[1] * ways[1])
    length = F.when(length == 0, 1.0).otherwise(length)
    lines = lines.withColumn("first", first)
    return lines.select(
        page, "b", "n", _text(F.col("spans")).alias("text"), "size", "raw_size", *RECT, (ways[0] / length).alias("dx"), (ways[1] / length).alias("dy"),
        F.coalesce(F.get("first.origin", F.lit(0)), "x0").alias("origin_x"), F.coalesce(F.get("first.origin", F.lit(1)), "y1").alias("origin_y"),
        F.coalesce("first.font", F.lit("")).alias("font"), _channels(F.col("first.color")).alias("color"),
    )


def dimension_spans(pages: DataFrame, page: str = "page_key") -> DataFrame:
    """(page, b, n, s, text, size, x0, y0, x1, y1, font, color) of the spans that look like a dimension: a size, a digit, and no more than 24 letters that dimensions have."""
    spans = _lines(pages, page).select(page, "b", "n", F.posexplode("line.spans").alias("s", "span"))
    spans = spans.select(page, "b", "n", "s", F.trim(_text(F.array("span"))).alias("text"), F.coalesce("span.size", F.lit(0.0)).alias("size"), *_corners(F.col("span.bbox")), F.coalesce("span.font", F.lit("")).alias("font"), _channels(F.col("span.color")).alias("color"))
    compact = F.regexp_replace("text", r"(?U)\s+", "")
    return spans.where((F.col("size") > 0) & F.length(compact).between(1, LONGEST) & compact.rlike(r"(?U)\d") & compact.rlike(DIMENSION_TEXT))
