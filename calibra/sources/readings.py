"""Readings of drawing pages from what recognisers write, with an identity that later steps can rely on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.functions import geometry as g

#: What a batch of a line recogniser holds, as JSON.
OCR_JSON = "results array<struct<text_angle: double, lines: array<struct<text: string, words: array<struct<text: string, x: double, y: double, width: double, height: double>>>>>>"
LONGEST_FILE = 262_144_000


def ocr_words(spark: SparkSession, path: str, payload: str = "value") -> DataFrame:
    """(job_id, line_no, text, angle, x0, y0, x1, y1): lines of JSON payloads, one to a row of text, with the box around each line's words.

    job_id is the place of a result in its batch, so results keep the order of the jobs.
    """
    rows = spark.read.text(path).select(F.from_json(F.col(payload), OCR_JSON).alias("p"), F.input_file_name().alias("file"))
    jobs = rows.select("file", F.posexplode("p.results").alias("job_id", "r"))
    lines = jobs.select("file", "job_id", F.col("r.text_angle").alias("angle"), F.posexplode("r.lines").alias("line_no", "l"))
    box = lambda f: F.transform("l.words", f)
    return lines.select(
        "file", "job_id", "line_no", F.col("l.text").alias("text"), "angle",
        F.array_min(box(lambda w: w.x)).alias("x0"), F.array_min(box(lambda w: w.y)).alias("y0"), F.array_max(box(lambda w: w.x + w.width)).alias("x1"), F.array_max(box(lambda w: w.y + w.height)).alias("y1"),
    ).where("text <> ''")


def from_quads(raw: DataFrame, floor: float) -> DataFrame:
    """Recognised boxes (text, score, quad) with rectangle and direction, without empty texts, quads of under four points and low scores."""
    kept = raw.where((F.col("score") >= floor) & (F.size("quad") >= 4) & (F.trim("text") != ""))
    return kept.withColumn("_r", g.bounds(F.col("quad"))).withColumn("_d", g.direction(F.col("quad"))).select(*raw.columns, "_r.*", "_d.*")


def numbered(readings: DataFrame, page: str = "page_key", order: Sequence[str | Column] = ("source_rank", "y0", "x0", "text", "score")) -> DataFrame:
    """readings with line_id, the place of a reading on its page by source and position. Assigned once; later merges go by it."""
    return readings.withColumn("line_id", F.row_number().over(Window.partitionBy(page).orderBy(*order)).cast("int"))


def together(*sources: DataFrame) -> DataFrame:
    """Readings of several passes in order of preference, with source_rank."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def tiles(pages: DataFrame, tile: Column | float, overlap: float = 0.18) -> DataFrame:
    """pages with (tile_x, tile_y, x0, y0, x1, y1): squares that cover 3 to 95 % of the width and 8 to 93 % of the height."""
    tile = tile if isinstance(tile, Column) else F.lit(tile)
    step = tile * (1 - overlap)

    def starts(lo: Column, hi: Column) -> Column:
        count = F.greatest(F.lit(1), (F.ceil((hi - lo - tile) / step) + 1).cast("int"))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.greatest(lo, F.least(lo + k * step, hi - tile)))

    w, h = F.col("page_w"), F.col("page_h")
    rows = pages.select("*", F.posexplode(starts(w * 0.03, w * 0.95)).alias("tile_x", "x0")).select("*", F.posexplode(starts(h * 0.08, h * 0.93)).alias("tile_y", "y0"))
    return rows.withColumn("x1", F.col("x0") + tile).withColumn("y1", F.col("y0") + tile)


def files(spark: SparkSession, path: str, glob: str = "*.pdf", newest: int | None = None) -> DataFrame:
    """(path, modificationTime, length) of files, checked for size; the newest ones alone if asked for."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "modificationTime", "length")
    found = found.withColumn("valid", F.col("length").between(1, LONGEST_FILE))
    return found.orderBy(F.desc("modificationTime"), "path").limit(newest) if newest else found


def full_page_images(images: DataFrame) -> DataFrame:
    """(page_key, full) of (page_key, area, page_area, and place if they have an order): an image over 72 % of the page, or all together.

    Shares are added up in order of place (without one by size, from the least), whatever order rows come in: of images
    that make up 72 % and no more the last bit of the sum decides, and that depends on the order.
    """
    place = ["place"] if "place" in images.columns else []
    share = F.struct(*place, (F.col("area") / F.col("page_area")).alias("share"))
    shares = images.groupBy("page_key").agg(F.array_sort(F.collect_list(share)).alias("shares"))
    add = F.aggregate("shares.share", F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).when(x.isNull(), s).otherwise(s + x))
    return shares.select("page_key", ((F.array_max("shares.share") >= 0.72) | (add >= 0.72)).alias("full"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, value) of JSON files {name, dimensions: [{kind, value}]}."""
    schema = "name string, description string, dimensions array<struct<kind: string, value: double>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.lower("name").alias("name"), F.explode("dimensions").alias("d")).select("name", "d.kind", "d.value")


def bad_inputs(found: DataFrame) -> DataFrame:
    """(path, reason) of files (path, length, and pages and locked if a reader has told them) that can't be opened."""
    has = lambda c: F.col(c) if c in found.columns else F.lit(None)
    reason = (
        F.when(~F.lower("path").endswith(".pdf"), "not a pdf").when(F.col("length") < 1, "empty").when(F.col("length") > LONGEST_FILE, "too large")
        .when(has("locked").cast("boolean"), "locked").when(has("pages").cast("int") < 1, "without pages")
    )
    return found.select("path", reason.alias("reason")).where("reason is not null")


def truth_of(found: DataFrame, truth: DataFrame) -> DataFrame:
    """truth (name, ...) with the path of the file of that name, whatever its case; of files of one name the first path."""
    stem = F.lower(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    return truth.join(found.groupBy(stem.alias("name")).agg(F.min("path").alias("path")), "name")
