"""The correction log as a stream: the batch definitions over a streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.plans import sample_log as SL


def log_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """Corrections from Parquet files of events as they arrive in ``folder``."""
    return SL.correction_log(spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def pattern_counts(log: DataFrame) -> DataFrame:
    """Running support and outcomes of every pattern (update or complete mode)."""
    return log.groupBy("source", "target").agg(F.count(F.lit(1)).alias("support"), F.count_if("accepted").alias("accepts"), F.sum("confidence").alias("confidence"))


def _timed(log: DataFrame) -> DataFrame:
    """Event time must be a point in time, not a wall clock reading."""
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


def acceptance(log: DataFrame, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Acceptance by tumbling window; corrections later than the watermark are dropped, windows close behind it."""
    w = _timed(log).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "source").agg(F.count_if("accepted").alias("accepts"), F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("from_ts"), "source", "accepts", "n")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's corrections without a pause over ``gap`` as one session."""
    w = _timed(log).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("corrections"), F.count_if("accepted").alias("accepts"))
    return w.select("user_id", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "corrections", "accepts")
