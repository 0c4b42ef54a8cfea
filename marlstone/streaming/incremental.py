"""Incremental ingest: new archive lines to posts, late copies dropped, daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.sources.archive import ingest


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, late: str = "30 days") -> StreamingQuery:
    """Ingest what is new under ``source`` and stop; ids seen within the watermark are written once."""
    lines = spark.readStream.text(source)
    posts = ingest(lines).withColumn("created", F.timestamp_seconds("created_utc"))
    once = posts.withWatermark("created", late).dropDuplicatesWithinWatermark(["id"])
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, time: str, kind: str, late: str = "1 day") -> DataFrame:
    """``day, kind, n`` by event time; works on batch and streaming frames alike."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), kind, "n")
