"""Pages of dimension readings made from the columns of an order table, alike in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Width and height of a synthetic page.
WIDTH, HEIGHT = 520.0, 380.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(page_key, line_id, prefix, nominal, text, score, x0, y0, x1, y1, tolerance): one reading for each order line.

    line_id numbers a page's readings from 1 by all columns they come from; the same readings get the same numbers in
    whatever order they are read. more: columns of the order line to keep beside them.
    """
    t = read(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    prefix = F.get(F.array(F.lit(""), F.lit("φ"), F.lit("R"), F.lit("C")), (F.col("l_linenumber") % 4).cast("int"))
    digits = F.col("l_quantity").cast("int").cast("string")
    tolerance = F.round(F.col("l_discount") * 100).cast("int")
    out = t.select(
        F.col("l_orderkey").alias("page_key"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("line_id"),
        prefix.alias("prefix"), F.col("l_quantity").alias("nominal"),
        F.concat(prefix, digits, F.when(tolerance > 0, F.concat(F.lit("±0."), F.lpad(tolerance.cast("string"), 2, "0"))).otherwise("")).alias("text"),
        F.round(F.lit(1.0) - F.col("l_discount") * 5, 6).alias("score"),
        (F.col("l_partkey") % 500).cast("double").alias("x0"), (F.col("l_suppkey") % 300 + 10 * F.col("l_linenumber")).cast("double").alias("y0"),
        (8 + F.col("l_quantity") / 5).alias("w"), tolerance.alias("tolerance"), *more,
    )
    return out.withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + 8.0).drop("w")


#: The same in DuckDB, as the view that all page queries start from.
LINES_SQL = """
lines AS (
  SELECT page_key, line_id, prefix, nominal,
         prefix || CAST(CAST(nominal AS INTEGER) AS VARCHAR) || CASE WHEN tolerance > 0 THEN '±0.' || lpad(CAST(tolerance AS VARCHAR), 2, '0') ELSE '' END AS text,
         score, x0, y0, x0 + w AS x1, y0 + 8.0::DOUBLE AS y1, tolerance
  FROM (
    SELECT l_orderkey AS page_key,
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER) AS line_id,
           ['', 'φ', 'R', 'C'][l_linenumber % 4 + 1] AS prefix, l_quantity AS nominal,
           CAST(round(l_discount * 100) AS INTEGER) AS tolerance, round(1.0::DOUBLE - l_discount * 5, 6) AS score,
           CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey % 300 + 10 * l_linenumber AS DOUBLE) AS y0, 8 + l_quantity / 5 AS w
    FROM lineitem
  )
)
"""
