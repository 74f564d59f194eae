"""Sinks: predictions, crops, pages, timings and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def predictions(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Regions, texts and boxes of a run as Parquet, partitioned by run; writing a run again replaces it."""
    for name, df in tables.items():
        target = df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        target.partitionBy("run_id").parquet(f"{path.rstrip('/')}/{name}")


def standalone(words: DataFrame, path: str) -> None:
    """Boxes (x, y, w, h) and texts of words found without lines; one row holds both, so their numbers cannot differ."""
    words.select("image_id", "region_idx", "word_idx", "gx", "gy", "gw", "gh", "text").write.mode("overwrite").parquet(path)


def image_crops(crops: DataFrame, path: str) -> None:
    """Pixels of image regions, with the relative path that pages refer to."""
    crops.select("image_id", "region_idx", "img_src", "height", "width", "data").write.mode("overwrite").parquet(path)


def pages(html: DataFrame, path: str) -> None:
    """One text file a page, in a folder named by its image."""
    html.select(F.col("image_id"), F.col("html").alias("value")).repartition("image_id").write.mode("overwrite").partitionBy("image_id").text(path)


def csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """A table with a header line, sorted if an order is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True)


def runtimes(totals: DataFrame, path: str) -> None:
    csv(totals.select(F.col("image_id").alias("img"), F.col("full_pipeline")), path)


def word_scores(scores: DataFrame, path: str) -> None:
    """A folder of score rows for each document, by region and word."""
    named = scores.select(F.col("image_id").alias("file_stem"), "dla_box_idx", "gt_word_idx", "gt_word", "pred_word_idx", "pred_word", "cer", F.col("lev").alias("levenshtein distance"))
    named.repartition("file_stem").sortWithinPartitions("file_stem", "dla_box_idx", "gt_word_idx").write.mode("overwrite").partitionBy("file_stem").csv(path, header=True)


def metrics_v1(metrics: DataFrame, path: str) -> None:
    csv(metrics, path, ["average_NED", "file_stem"])


def metrics_v2(metrics: DataFrame, path: str) -> None:
    csv(metrics, path, ["file_stem"])
