"""Incremental ingest of text files: what arrives is cut into pages and its tags are found as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.operators.search import is_tag, tags_in
from tagloom.sources.schemas import FILES


def arriving(spark: SparkSession, folder: str, schema: str = FILES) -> DataFrame:
    """Files of a folder of Parquet parts, each read once."""
    return spark.readStream.schema(schema).parquet(folder)


def mentions(files: DataFrame) -> DataFrame:
    """(file_id, tag) of the valid tags in each arriving file's text."""
    found = files.select("file_id", F.explode(F.array_distinct(tags_in(F.col("pure_text")))).alias("tag"))
    return found.filter(is_tag(F.col("tag")))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the mentions of everything new in folder to out, then stop; runs again from where it stopped."""
    return mentions(arriving(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n): events of each window and type; a window's row comes when no event of it is still awaited."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    return at.withWatermark("at", late).groupBy(F.window("at", every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
