"""Sources: image folders, annotation files, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry import schemas
from pagequarry.functions.geometry import file_extension, file_stem


def file_name(path) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def images(spark: SparkSession, directory: str) -> DataFrame:
    """Decoded images of a folder, but for CSV files: key (file stem), name, extension, size and pixels (blue first)."""
    rows = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "*").load(directory)
    name = file_name(F.col("image.origin"))
    rows = rows.withColumn("file_name", name).where(~F.col("file_name").endswith(".csv"))
    return rows.select(
        file_stem(F.col("file_name")).alias("image_id"), "file_name", file_extension(F.col("file_name")).alias("ext"),
        F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"), F.col("image.mode").alias("mode"), F.col("image.data").alias("data"),
    )


def image_files(spark: SparkSession, directory: str) -> DataFrame:
    """Names and byte sizes of a folder's files; contents are not read."""
    rows = spark.read.format("binaryFile").load(directory)
    return rows.select(file_name(F.col("path")).alias("file_name"), F.col("length").alias("n_bytes")).where(~F.col("file_name").endswith(".csv"))


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of layout annotation files; the first image of a name counts."""
    whole = spark.read.schema(schemas.COCO_FILE).json(path, multiLine=True)
    pictures = whole.select(F.posexplode("images").alias("pos", "i")).select("pos", F.col("i.id").alias("coco_image_id"), "i.file_name")
    pictures = pictures.groupBy("file_name").agg(F.min_by("coco_image_id", "pos").alias("coco_image_id"))
    annotations = whole.select(F.posexplode("annotations").alias("pos", "a")).select("pos", F.col("a.id").alias("ann_id"), F.col("a.image_id").alias("coco_image_id"), "a.category_id", "a.bbox")
    return pictures, annotations


def coco_regions(pictures: DataFrame, annotations: DataFrame, categories: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Ground-truth text regions of each image, numbered in file order."""
    from pyspark.sql import Window

    rows = annotations.where(F.col("category_id").isin(*categories)).join(pictures, "coco_image_id")
    order = Window.partitionBy("file_name").orderBy("pos")
    at = lambda i: F.element_at("bbox", i)
    return rows.select("file_name", (F.row_number().over(order) - 1).cast("int").alias("gt_idx"), "ann_id", "category_id", at(1).alias("x0"), at(2).alias("y0"), (at(1) + at(3)).alias("x1"), (at(2) + at(4)).alias("y1"))


def region_texts(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth texts (file_name, id, text), as Parquet or JSON lines; the first text of an id counts."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(schemas.GT_TEXT_FILE).json(path)
    return rows.groupBy("file_name", "id").agg(F.first("text").alias("text"))


def with_region_texts(regions: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions with text, regions whose text is missing: must be empty)."""
    key = (F.col("file_name") == F.col("_file")) & (F.col("ann_id") == F.col("id"))
    named = texts.select(F.col("file_name").alias("_file"), "id", "text")
    return regions.join(named, key).drop("_file", "id"), regions.join(named, key, "left_anti")


def via_words(files: DataFrame, annotations: DataFrame, json_col: str = "json") -> DataFrame:
    """Rectangular word annotations of each image: (file_name, word_pos, x0.., text).

    `files` has file_name and n_bytes; `annotations` one JSON object for each image, keyed by name and size.
    """
    parsed = annotations.select(F.from_json(json_col, f"MAP<STRING, STRUCT<{_fields(schemas.VIA_FILE)}>>").alias("m"))
    entries = parsed.select(F.explode("m").alias("key", "entry"))
    keyed = files.withColumn("key", F.concat("file_name", F.col("n_bytes").cast("string")))
    words = keyed.join(entries, "key").select("file_name", F.posexplode("entry.regions").alias("pos", "r")).where("r.shape_attributes.name = 'rect'")
    return rectangles(words)


def rectangles(words: DataFrame) -> DataFrame:
    """Annotated rectangles, numbered among themselves."""
    from pyspark.sql import Window

    s = lambda c: F.col(f"r.shape_attributes.{c}")
    order = Window.partitionBy("file_name").orderBy("pos")
    return words.select("file_name", (F.row_number().over(order) - 1).cast("int").alias("word_pos"), s("x").alias("x0"), s("y").alias("y0"), (s("x") + s("width")).alias("x1"), (s("y") + s("height")).alias("y1"), F.col("r.region_attributes.name").alias("text"))


def _fields(ddl: str) -> str:
    """A table's DDL as the inside of a STRUCT type."""
    name, _, kind = ddl.partition(" ")
    return f"{name}: {kind}"


def predictions(spark: SparkSession, path: str, run_id: str, table: str) -> DataFrame:
    """A table of one run, as `sinks.predictions` wrote it."""
    return spark.read.parquet(f"{path.rstrip('/')}/{table}").where(F.col("run_id") == run_id)
