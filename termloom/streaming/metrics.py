"""Streaming forms: counts in windows with late data, and running recall over a log of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks want a timestamp with a zone; columns without one are taken in the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and kind; rows later than ``late`` are dropped with their window closed."""
    return _event_time(events, ts).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def windowed_recall(results: DataFrame, ts: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """recall@1 and @10 and MRR by window over results(ts, correct_rank)."""
    hit = lambda k: F.avg(((F.col("correct_rank") >= 1) & (F.col("correct_rank") <= k)).cast("double"))
    mrr = F.avg(F.when(F.col("correct_rank") > 0, 1.0 / F.col("correct_rank")).otherwise(0.0))
    return _event_time(results, ts).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), hit(1).alias("recall_at_1"), hit(10).alias("recall_at_10"), mrr.alias("mrr")).select(F.col("w.start").alias("start"), "n", "recall_at_1", "recall_at_10", "mrr")


def dedupe_stream(rows: DataFrame, key: str, ts: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return _event_time(rows, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan over what is there now, into a table; returns the table."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
