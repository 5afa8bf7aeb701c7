"""Where results go: bands and labels for a renderer, reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export(bands: DataFrame, additions: DataFrame, n_pages: int, source: str, target: str) -> None:
    """Writes the items of a document in the order they are drawn, fills before the rest. The source is never written over."""
    if target.rstrip("/") == source.rstrip("/"):
        raise ValueError("the target must not be the source")
    fills = bands.select("page_index", F.lit(True).alias("is_fill"), "ordinal", F.to_json(F.struct(*bands.columns)).alias("item"))
    rest = additions.select("page_index", F.lit(False).alias("is_fill"), "ordinal", F.to_json(F.struct(*additions.columns)).alias("item"))
    checked = fills.unionByName(rest).withColumn("page_index", F.when(F.col("page_index").between(0, n_pages - 1), F.col("page_index")).otherwise(F.raise_error(F.lit("a page that isn't there")).cast("int")))
    checked.repartition("page_index").sortWithinPartitions("page_index", F.desc("is_fill"), "ordinal").write.parquet(target)


def report(table: DataFrame, target: str) -> None:
    """A small table as JSON lines."""
    table.write.json(target)


def log_summary(counts: DataFrame) -> DataFrame:
    """(pipeline, summary) of (pipeline, stage, n): k=v pairs in order of the stage."""
    pairs = F.sort_array(F.collect_list(F.concat("stage", F.lit("="), F.col("n").cast("string"))))
    return counts.groupBy("pipeline").agg(F.array_join(pairs, " ").alias("summary"))
