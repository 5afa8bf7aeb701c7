"""Review sessions as streams: the folds of calibra.operators.session, kept up to date as events come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def selections(log: DataFrame) -> DataFrame:
    """(user_id, item, selected, n_toggles) as of now; state is one count for each key."""
    n = F.count("*")
    return log.groupBy("user_id", F.col("event_type").alias("item")).agg((n % 2 == 1).alias("selected"), n.alias("n_toggles"))


def activity(log: DataFrame, late: str = "10 minutes", window: str = "5 minutes", slide: str = "5 minutes") -> DataFrame:
    """(window, event_type, n, total) for event time windows; events later than the watermark are left out."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(window, user_id, n): stretches of a user's events without a pause longer than the gap."""
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def start(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs what is there and stops, into a table in memory."""
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
