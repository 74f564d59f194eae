"""Structured Streaming extension (beyond parity): pages arrive as files, results leave as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry import schemas


def word_stream(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """Recognised words, from Parquet files of `schemas.WORDS` that arrive in a folder."""
    return spark.readStream.schema(schemas.WORDS).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def write_texts(words: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Region texts of each batch of pages; a page's words must arrive in one file. Batches replace their own folder, so a repeated batch counts once."""
    from pagequarry.operators import layout

    def save(batch: DataFrame, number: int) -> None:
        layout.region_texts(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return words.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_windows(timings: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Runs and seconds of each stage by time window; of a batch or, with a watermark, of a stream (stage, ts, seconds)."""
    rows = timings.withWatermark("ts", late) if timings.isStreaming else timings
    found = rows.groupBy("stage", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"))
    return found.select("stage", F.col("w.start").alias("window_start"), "n", "seconds")
