"""Streaming forms: snapshot ingest and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums per tumbling hour and type; works on batches and streams (append mode, late rows beyond the watermark are left to a repair batch)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform=lambda df: df, fmt: str = "parquet") -> None:
    """All files not seen yet, once, appended to the target as Parquet; exactly once through the checkpoint."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()


def distinct_posts(stream: DataFrame, late: str = "6 hours") -> DataFrame:
    """Rows without repeats of (snapshot_id, post_id) within the watermark."""
    return stream.withWatermark("snapshot_time", late).dropDuplicatesWithinWatermark(["snapshot_id", "post_id"])


def sliding_repeats(stream: DataFrame, probes: DataFrame, span: str = "24 hours") -> DataFrame:
    """Stream-stream interval join: for each probe the rows of the same key in the span before it (own id excluded)."""
    a = stream.withWatermark("ts", span).select(F.col("key").alias("k1"), F.col("id").alias("id1"), F.col("ts").alias("t1"))
    b = probes.withWatermark("ts", span).select("key", "id", "ts")
    return b.join(a, F.expr(f"k1 = key AND id1 != id AND t1 < ts AND t1 >= ts - INTERVAL {span}"))


def silence_windows(events: DataFrame, key: str, gap: str = "2 days", late: str = "1 day") -> DataFrame:
    """Sessions that end after a silence: the online stand-in for the exact day rule."""
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
