"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import cut


def _toward_least(edges: DataFrame, pick: Column) -> DataFrame:
    """edges (u, v): for each u, links the neighbours that pick selects to the least of u and its neighbours (m)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u").select(F.col("v"), F.col("m"), F.col("u")).where(pick)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node that stands in a link, the least node it can reach.

    links: two long columns; order, repeats and loops don't matter, rows with a null are left out. Empty links give
    an empty result. Each round is one grouped minimum (combined before the shuffle) and one join that adaptive
    execution may split at hot nodes; rounds grow with the logarithm of the longest path. Nothing is gathered on the
    driver but a count.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = cut(edges, small=True)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, small=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
