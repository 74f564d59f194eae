"""Plans from images to text and pages: one lazy DataFrame graph each, no loop over images."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pagequarry.functions import html
from pagequarry.functions.text import normalised_word
from pagequarry.operators import inference, layout

REGION, LINE, WORD = ["image_id", "region_idx"], ["image_id", "region_idx", "line_idx"], ["image_id", "region_idx", "line_idx", "word_idx"]


@dataclass(frozen=True)
class Models:
    """Functions that load the models, called on executors."""

    layout: Callable[[], inference.LayoutAnalyzer] = inference.InkLayout
    lines: Callable[[], inference.Detector] = inference.InkDetector
    words: Callable[[], inference.Detector] = inference.InkDetector
    recogniser: Callable[[], inference.Recognizer] = inference.MeanRecogniser


@dataclass(frozen=True)
class Reading:
    """What a plan gives: regions with text, lines and words with page boxes, crops of image regions."""

    regions: DataFrame
    lines: DataFrame
    words: DataFrame
    pictures: DataFrame
    images: DataFrame | None = None

    def html(self) -> DataFrame:
        """A page for every image, also those without regions."""
        return html.documents(self.regions, self.images)


def regions_of(images: DataFrame, models: Models) -> DataFrame:
    """Detected regions that no earlier one covers, with pixel corners and sources of image crops."""
    found = layout.pixel_boxes(layout.project_regions(inference.detect_layout(images, models.layout)))
    kept = layout.suppress_overlaps(found, ("px0", "py0", "px1", "py1"))
    extension = images.select("image_id", "ext") if "ext" in images.columns else images.select("image_id", F.lit("png").alias("ext"))
    return layout.image_sources(kept.join(extension.hint("merge"), "image_id"), F.col("image_id"), F.col("ext")).drop("ext")


def boxes(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(f"{prefix}{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


def read_pages(images: DataFrame, models: Models = Models()) -> Reading:
    """Layout, lines, words and texts of images (image_id, height, width, n_channels, data)."""
    regions = regions_of(images, models)
    text = layout.padded_text_regions(regions.drop("px0", "py0", "px1", "py1"))
    crops = inference.crop_images(boxes(text, "p", REGION), images, REGION, pad_ratio=1.2)
    lines = layout.line_boxes(inference.detect_lines(crops, models.lines), text)
    lines = layout.nonempty_crops(layout.apply_dilations(layout.dilate_lines_horizontally(layout.dilate_lines_vertically(lines))))
    line_crops = inference.crop_images(lines, crops, LINE, on=("image_id", "region_idx"))
    words = layout.word_boxes(inference.detect_words(line_crops, models.words))
    words = layout.dilate_words(words.join(line_crops.select(*LINE, F.col("height").alias("line_h"), F.col("width").alias("line_w")).hint("merge"), LINE))
    word_crops = inference.crop_images(boxes(words.where("crop_ok"), "c", WORD), line_crops, WORD, on=("image_id", "region_idx", "line_idx"))
    texts = inference.recognise(word_crops, models.recogniser, normalise=normalised_word)
    words = layout.words_on_page(words, lines).join(texts.hint("merge"), WORD, "left").withColumn("text", F.coalesce("text", F.lit("")))
    written = regions.drop("text").join(layout.region_texts(words).withColumnRenamed("region_text", "text").hint("merge"), REGION, "left").withColumn("text", F.coalesce("text", F.lit("")))
    pictures = regions.where(F.col("class") == "image")
    pictures = inference.crop_images(boxes(pictures, "p", REGION), images, REGION).join(pictures.select(*REGION, "img_src").hint("merge"), REGION)
    return Reading(layout.single_lines(written, lines), lines, words, pictures, images.select("image_id"))


def read_regions(images: DataFrame, models: Models = Models()) -> DataFrame:
    """The variant without lines: words found in region crops, cut upright, with texts and page boxes as x, y, w, h."""
    text = layout.padded_text_regions(regions_of(images, models).drop("px0", "py0", "px1", "py1"))
    crops = inference.crop_images(boxes(text, "p", REGION), images, REGION, pad_ratio=1.2)
    quads = inference.detect_words(crops, models.words, by_line=False).withColumnRenamed("det_idx", "word_idx")
    words = layout.region_words_on_page(quads.withColumns(layout.word_box("quad").named()), text)
    cut = inference.rotated_crops(quads, crops, [*REGION, "word_idx"], on=("image_id", "region_idx"))
    texts = inference.recognise(cut, models.recogniser, normalise=normalised_word)
    return words.join(texts.hint("merge"), [*REGION, "word_idx"])
