"""Reports: funnels, precision and recall, modal styles, corpus audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def funnel(rows: DataFrame, stage: str = "stage") -> DataFrame:
    """(stage, n): how many rows each stage or reason holds."""
    return rows.groupBy(stage).agg(F.count("*").alias("n"))


def scores(truth: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """(hits, n_found, n_truth, precision, recall, f1) over distinct keys; 0 where there is nothing to divide by."""
    marks = truth.select(*key, F.lit(1).alias("t"), F.lit(0).alias("f")).unionByName(found.select(*key, F.lit(0).alias("t"), F.lit(1).alias("f")))
    each = marks.groupBy(*key).agg(F.max("t").alias("t"), F.max("f").alias("f"))
    total = each.agg(F.coalesce(F.sum(F.col("t") * F.col("f")), F.lit(0)).alias("hits"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_found"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_truth"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    hits, n_found, n_truth = F.col("hits"), F.col("n_found"), F.col("n_truth")
    return total.select("hits", "n_found", "n_truth", share(hits, n_found).alias("precision"), share(hits, n_truth).alias("recall"), share(2.0 * hits, n_found + n_truth).alias("f1"))


def recall_by_alias(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(name, hit) of truth (name, key, aliases): whether the key or an alias stands among the found texts."""
    names = truth.select("name", F.explode(F.array_union(F.array("key"), "aliases")).alias("text"))
    hits = names.join(found.select("text").distinct(), "text", "left_semi").select("name").distinct().withColumn("hit", F.lit(True))
    return truth.select("name").join(hits, "name", "left").select("name", F.coalesce("hit", F.lit(False)).alias("hit"))


def modal_style(spans: DataFrame, by: str, preferred: Column) -> DataFrame:
    """The most frequent (font, size) of each group; of equals the preferred, then the larger, then the later by name."""
    counts = spans.groupBy(by, "font", "size").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", preferred.alias("preferred"), "size", "font")).alias("m")
    return counts.groupBy(by).agg(best).select(by, "m.font", "m.size", "m.n")


def popular_fonts(spans: DataFrame, by: str) -> DataFrame:
    """Fonts of a group that are used often enough: once if none has four uses, else 8 % of the most used one, two at least."""
    counts = spans.groupBy(by, "font").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(by))
    least = F.when(most < 4, 1).otherwise(F.greatest(F.lit(2), F.ceil(most * 0.08)))
    return counts.withColumn("least", least).where("n >= least").drop("least")


def modal_width(strokes: DataFrame, by: str) -> DataFrame:
    """The most frequent stroke width of 0.08 to 0.75, to two digits; the thinner of equals; 0.35 if there is none."""
    kept = F.when(F.col("width").between(0.08, 0.75), F.round("width", 2))
    counts = strokes.groupBy(by, kept.alias("width")).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.coalesce(F.max_by("width", F.when(F.col("width").isNotNull(), F.struct("n", -F.col("width")))), F.lit(0.35)).alias("width"))


def audit(files: DataFrame) -> DataFrame:
    """One row on a corpus (n_chars, has_image, family): shares of files with text and images, and of families with several files."""
    families = files.groupBy("family").agg(F.count("*").alias("n")).agg(F.avg((F.col("n") > 1).cast("double")).alias("repeated_family_ratio"))
    total = files.agg(F.count("*").alias("n_files"), F.avg((F.col("n_chars") >= 40).cast("double")).alias("text_ratio"), F.avg(F.col("has_image").cast("double")).alias("image_ratio"), F.median("n_chars").alias("median_length"))
    return total.join(F.broadcast(families))


def nearest_span(spans: DataFrame, styles: DataFrame, by: str, x: Column, y: Column) -> DataFrame:
    """Of each group's spans in its style (font, size) the one whose middle is nearest to a point; of equals the first by line_id."""
    from calibra.functions import geometry as g

    r = g.Rect.of()
    far = g.distance((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2, x, y)
    return spans.join(styles.select(by, "font", "size"), [by, "font", "size"]).groupBy(by).agg(F.min_by("line_id", F.struct(far.alias("far"), F.col("line_id"))).alias("line_id"))


def annotations(files: DataFrame) -> DataFrame:
    """(type, n, annotated_ratio, median_pages) of files (pages, types): how often each type of annotation stands in them, beside the share of files that have any and their median length."""
    kinds = files.select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    whole = files.agg(F.avg((F.size("types") > 0).cast("double")).alias("annotated_ratio"), F.median("pages").alias("median_pages"))
    return kinds.join(F.broadcast(whole))
