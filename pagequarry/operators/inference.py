"""Models as DataFrame operators: protocols, factories that run a model inside Arrow batches, deterministic stand-ins.

A factory takes a function that loads the model; it runs once per Python worker and task, on the executor, so weights are
never pickled. Weights are local paths; nothing is downloaded. Spark takes a model's output for as small as its input, so what
is joined with it is hinted to be merged: pixels and boxes grow with the images and are not to be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pagequarry import schemas
from pagequarry.functions.text import SEPARATOR, VOCABULARY
from pagequarry.operators import pixels


class LayoutAnalyzer(Protocol):
    def get_rois(self, image: np.ndarray) -> list[tuple[float, float, float, float, int]]:
        """(x0, y0, x1, y1, class id) of each region, in the detector's order."""


class Detector(Protocol):
    def get_line_boxes(self, image: np.ndarray) -> list[list[float]]:
        """Flat quads of the text lines of a region crop."""

    def get_word_boxes(self, image: np.ndarray) -> list[list[float]]:
        """Flat quads of the words of a line or region crop."""


class Recognizer(Protocol):
    def logits(self, inputs: dict[str, np.ndarray]) -> np.ndarray:
        """(batch, positions, vocabulary) scores."""


@dataclass(frozen=True)
class DetectorOptions:
    """Options of differentiable-binarisation detectors."""

    max_side: int = 960
    threshold: float = 0.3
    box_threshold: float = 0.6
    unclip: float = 1.5
    score_mode: str = "slow"
    dilation: bool = False
    device: str = "cpu"
    device_id: int = 0


@dataclass(frozen=True)
class JobOptions:
    """Models and device of a run; `from_conf` reads them from a session's settings."""

    line_model: str = ""
    word_model: str = ""
    recogniser: str = ""
    layout_model: str = ""
    device: str = "cpu"
    device_id: int = 0

    @staticmethod
    def from_conf(spark, prefix: str = "spark.pagequarry.") -> JobOptions:
        read = lambda name, other: spark.conf.get(f"{prefix}{name}", other)
        return JobOptions(*(read(n, "") for n in ("line_model", "word_model", "recogniser", "layout_model")), device=read("device", "cpu"), device_id=int(read("device_id", "0")))


#: Crops in one call of the recogniser.
RECOGNISER_BATCH = 160


def detect_layout(images: DataFrame, load: Callable[[], LayoutAnalyzer]) -> DataFrame:
    """Detections of every image."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                for i, (x0, y0, x1, y1, kind) in enumerate(model.get_rois(pixels.image_of(r.data, r.height, r.width, r.n_channels))):
                    rows.append((r.image_id, i, float(x0), float(y0), float(x1), float(y1), int(kind), r.height, r.width))
            yield pd.DataFrame(rows, columns=["image_id", "region_idx", "x0", "y0", "x1", "y1", "class_id", "img_height", "img_width"])

    return images.select("image_id", "height", "width", "n_channels", "data").mapInPandas(run, schemas.DETECTIONS)


def _detect(crops: DataFrame, load: Callable[[], Detector], method: str, keys: list[str], ddl: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = getattr(load(), method)
        for frame in frames:
            rows = [(*(getattr(r, k) for k in keys), i, [float(v) for v in quad]) for r in frame.itertuples(index=False) for i, quad in enumerate(find(pixels.image_of(r.data, r.height, r.width)))]
            yield pd.DataFrame(rows, columns=[*keys, "det_idx", "quad"])

    return crops.select(*keys, "height", "width", "data").mapInPandas(run, ddl)


def detect_lines(crops: DataFrame, load: Callable[[], Detector]) -> DataFrame:
    """Line quads of region crops."""
    return _detect(crops, load, "get_line_boxes", ["image_id", "region_idx"], schemas.QUADS)


def detect_words(crops: DataFrame, load: Callable[[], Detector], by_line: bool = True) -> DataFrame:
    """Word quads of line crops, or of region crops."""
    if not by_line:
        return _detect(crops, load, "get_word_boxes", ["image_id", "region_idx"], schemas.QUADS)
    return _detect(crops, load, "get_word_boxes", ["image_id", "region_idx", "line_idx"], "image_id STRING, region_idx INT, line_idx INT, det_idx INT, quad ARRAY<DOUBLE>")


def decode_tokens(tokens: np.ndarray, vocabulary: list[str] = VOCABULARY, separator: int = SEPARATOR) -> list[str]:
    out = []
    for row in tokens:
        body = row[1:].tolist()
        out.append("".join(vocabulary[t] for t in (body[: body.index(separator)] if separator in body else body)))
    return out


def recognise(crops: DataFrame, load: Callable[[], Recognizer], batch: int = RECOGNISER_BATCH, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Crops with `text`: batches of fitted crops through the model, best token of each position, decoded. Crops without area have the text ''."""
    keys = [c for c in crops.columns if c not in ("height", "width", "data")]
    out = T.StructType([*crops.select(*keys).schema.fields, T.StructField("text", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            texts = [""] * len(frame)
            full = [i for i, (h, w) in enumerate(zip(frame["height"], frame["width"], strict=True)) if h > 0 and w > 0]
            for lo in range(0, len(full), batch):
                some = full[lo : lo + batch]
                inputs = pixels.batch([pixels.image_of(frame["data"].iloc[i], frame["height"].iloc[i], frame["width"].iloc[i]) for i in some])
                for i, text in zip(some, decode_tokens(model.logits(inputs).argmax(axis=-1)), strict=True):
                    texts[i] = text
            yield frame[keys].assign(text=texts)

    found = crops.mapInPandas(run, out)
    return found.withColumn("text", normalise(F.col("text"))) if normalise else found


def crop_images(boxes: DataFrame, images: DataFrame, keys: list[str], pad_ratio: float | None = None, on: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Crops (x0, y0, x1, y1 in pixels) of images or of other crops, joined by `on` and cut in Arrow batches; with pad_ratio, white rows are added."""
    channels = F.col("n_channels") if "n_channels" in images.columns else F.lit(3)
    joined = boxes.select(*keys, "x0", "y0", "x1", "y1").join(images.select(*on, F.col("height").alias("_h"), F.col("width").alias("_w"), channels.alias("_c"), "data").hint("merge"), list(on))
    out = T.StructType([*boxes.select(*keys).schema.fields, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cut = []
            for r in frame.itertuples(index=False, name=None):
                row = dict(zip(frame.columns, r, strict=True))
                part = pixels.crop(pixels.image_of(row["data"], row["_h"], row["_w"], row["_c"]), int(row["x0"]), int(row["y0"]), int(row["x1"]), int(row["y1"]))
                if pad_ratio and part.size:
                    part = pixels.pad_rows(part, pad_ratio)[0]
                cut.append((part.shape[0], part.shape[1], np.ascontiguousarray(part).tobytes()))
            yield frame[keys].assign(height=[c[0] for c in cut], width=[c[1] for c in cut], data=[c[2] for c in cut])

    return joined.mapInPandas(run, out)


def rotated_crops(quads: DataFrame, images: DataFrame, keys: list[str], on: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Upright crops of quads of images or of other crops, joined by `on`."""
    channels = F.col("n_channels") if "n_channels" in images.columns else F.lit(3)
    joined = quads.select(*keys, "quad").join(images.select(*on, F.col("height").alias("_h"), F.col("width").alias("_w"), channels.alias("_c"), "data").hint("merge"), list(on))
    out = T.StructType([*quads.select(*keys).schema.fields, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cut = []
            for data, h, w, c, quad in zip(frame["data"], frame["_h"], frame["_w"], frame["_c"], frame["quad"], strict=True):
                part = pixels.rotated_crop(pixels.image_of(data, h, w, c), np.array(quad, dtype=float).reshape(4, 2))
                cut.append((0, 0, b"") if part is None else (*part.shape[:2], np.ascontiguousarray(part).tobytes()))
            yield frame[keys].assign(height=[c[0] for c in cut], width=[c[1] for c in cut], data=[c[2] for c in cut])

    return joined.mapInPandas(run, out)


# models -----------------------------------------------------------------------------------------------------------------


class InkLayout:
    """Stand-in for a layout model: bands of rows with dark pixels are paragraphs."""

    def __init__(self, dark: int = 128, gap: int = 6):
        self.dark, self.gap = dark, gap

    def get_rois(self, image: np.ndarray) -> list[tuple[float, float, float, float, int]]:
        ink = image.min(axis=2) < self.dark
        return [(float(np.nonzero(ink[a:b].any(axis=0))[0][0]), float(a), float(np.nonzero(ink[a:b].any(axis=0))[0][-1] + 1), float(b), 0) for a, b in bands(ink.any(axis=1), self.gap)]


def bands(marks: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """Runs of marked places; runs with no more than gap places between them are one."""
    at = np.nonzero(marks)[0]
    if not len(at):
        return []
    cuts = np.nonzero(np.diff(at) > gap + 1)[0]
    return list(zip(at[np.append(0, cuts + 1)].tolist(), (at[np.append(cuts, len(at) - 1)] + 1).tolist(), strict=True))


class InkDetector:
    """Stand-in for a text detector: lines are bands of inked rows, words bands of inked columns."""

    def __init__(self, options: DetectorOptions = DetectorOptions(), dark: int = 128, word_gap: int = 3):
        self.options, self.dark, self.word_gap = options, dark, word_gap

    def quad(self, x0: int, y0: int, x1: int, y1: int) -> list[float]:
        return [float(v) for v in (x0, y0, x1, y0, x1, y1, x0, y1)]

    def get_line_boxes(self, image: np.ndarray) -> list[list[float]]:
        ink = image.min(axis=2) < self.dark
        out = []
        for a, b in bands(ink.any(axis=1), 0):
            columns = np.nonzero(ink[a:b].any(axis=0))[0]
            out.append(self.quad(columns[0], a, columns[-1] + 1, b))
        return out

    def get_word_boxes(self, image: np.ndarray) -> list[list[float]]:
        ink = image.min(axis=2) < self.dark
        rows = np.nonzero(ink.any(axis=1))[0]
        return [self.quad(a, rows[0], b, rows[-1] + 1) for a, b in bands(ink.any(axis=0), self.word_gap)] if len(rows) else []

    def get_crops(self, image: np.ndarray, quads: list[list[float]]) -> list[np.ndarray]:
        return [c for q in quads if (c := pixels.rotated_crop(image, np.array(q).reshape(4, 2))) is not None]


class MeanRecogniser:
    """Stand-in for a recogniser: the mean brightness of each eighth of a crop picks a token; eight tokens, then the separator."""

    def logits(self, inputs: dict[str, np.ndarray]) -> np.ndarray:
        images = inputs["image"]
        n, length = len(images), inputs["pos"].shape[1]
        out = np.zeros((n, length, len(VOCABULARY)), dtype=np.float32)
        eighths = images.reshape(n, images.shape[1], 8, -1, 3).mean(axis=(1, 3, 4))
        tokens = 1 + np.rint(eighths * 92).astype(int)
        for k in range(8):
            out[np.arange(n), k + 1, tokens[:, k]] = 1
        out[:, 9:, SEPARATOR] = 1
        return out


class OnnxRecogniser:
    """A recogniser from a local ONNX file with inputs `image` and `pos`."""

    def __init__(self, path: str, providers: tuple[str, ...] = ("CPUExecutionProvider",)):
        import onnxruntime

        self.session = onnxruntime.InferenceSession(path, providers=list(providers))

    def logits(self, inputs: dict[str, np.ndarray]) -> np.ndarray:
        return self.session.run(None, inputs)[0]
