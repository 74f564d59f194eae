"""Plan from predictions and ground truth to metrics, over all documents at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagequarry.operators import matching, metrics

#: From rows of a table that are together by image to their pages.
Reader = Callable[[Iterator[pa.RecordBatch]], Iterator[matching.Pages]]
PIVOT = "image_id string, gt_idx int, pred_word_idx int, gt_word_idx int, iou double"
SCORES = "image_id string, dla_box_idx int, gt_word_idx int, gt_word string, pred_word_idx int, pred_word string, cer double, lev int, correct boolean"
SUMS = "image_id string, n long, cer double, correct long, matched long"


@dataclass(frozen=True)
class Truth:
    """regions (image_id, gt_idx, x0.., text) and words (image_id, word_pos, x0.., text); images (image_id) that have a row of metrics, else those of regions."""

    regions: DataFrame
    words: DataFrame
    images: DataFrame | None = None

    def scored_images(self) -> DataFrame:
        return (self.regions if self.images is None else self.images).select("image_id").distinct()


@dataclass(frozen=True)
class Predicted:
    """text regions (image_id, pred_idx, x0.., region_text) and words (image_id, pred_idx, line_idx, word_idx, x0.., text)."""

    regions: DataFrame
    words: DataFrame


@dataclass(frozen=True)
class Alignment:
    matches: DataFrame
    superbox: DataFrame
    gt_words: DataFrame
    pred_words: DataFrame
    candidates: DataFrame


def align(truth: Truth, predicted: Predicted) -> Alignment:
    matches = matching.best_regions(predicted.regions, truth.regions)
    superbox = matching.superboxes(matches, truth.regions)
    gt_words = matching.words_in_regions(truth.words, truth.regions)
    pred_words = matching.merged_words(predicted.words, superbox)
    return Alignment(matches, superbox, gt_words, pred_words, matching.match_candidates(pred_words, gt_words))


def matched_words(a: Alignment, texts: bool = False) -> DataFrame:
    return matching.word_matches(a.pred_words, a.gt_words, texts)


def pred_pivot(a: Alignment) -> DataFrame:
    return matched_words(a).where("by_pred IS NOT NULL").select("image_id", "gt_idx", F.col("by_pred").alias("pred_word_idx"), "gt_word_idx", F.col("by_pred_iou").alias("iou"))


def gt_pivot(a: Alignment) -> DataFrame:
    return matched_words(a).where("pred_word_idx IS NOT NULL").select("image_id", "gt_idx", "pred_word_idx", "gt_word_idx", "iou")


def scores(a: Alignment) -> DataFrame:
    return metrics.scored_words(matched_words(a, texts=True))


def metrics_v1(truth: Truth, predicted: Predicted) -> DataFrame:
    sums = metrics.image_sums(matched_words(align(truth, predicted), texts=True))
    return metrics.rates(truth.scored_images().join(sums, "image_id", "left"))


def by_page(rows: DataFrame, read: Reader, columns: Callable[[matching.Pages, matching.Matched], pa.RecordBatch], ddl: str) -> DataFrame:
    """`columns` of the pages of rows that are dealt out by image_id; words, regions and matches of a page are arrays of one task, not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in read(batches):
            yield columns(pages, matching.page_matches(pages))

    return rows.sortWithinPartitions("image_id").mapInArrow(run, ddl)


def batch(ddl: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    made = [c if isinstance(c, pa.Array) else pa.array(c.astype(kinds[t].to_pandas_dtype())) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=list(names))


def page_pivot(partner: str) -> Callable[[matching.Pages, matching.Matched], pa.RecordBatch]:
    """gt_pivot (by_gt) or pred_pivot (by_pred) of pages."""

    def columns(pages: matching.Pages, m: matching.Matched) -> pa.RecordBatch:
        at, ratio = getattr(m, partner), getattr(m, f"{partner}_iou")
        rows = np.flatnonzero(at >= 0)
        return batch(PIVOT, pages.images.take(pa.array(m.image[rows])), m.gt_idx[rows], m.pred_word_idx[at[rows]], m.gt_word_idx[rows], ratio[rows])

    return columns


def page_scores(pages: matching.Pages, m: matching.Matched) -> pa.RecordBatch:
    """scores of pages."""
    found = metrics.page_scores(pages, m)
    rows = np.flatnonzero(found["gt_word"].is_valid().to_numpy(zero_copy_only=False))
    some = pa.array(rows)
    pred = np.where(m.by_gt < 0, -1, np.append(m.pred_word_idx, -1)[m.by_gt])
    return batch(SCORES, pages.images.take(pa.array(m.image[rows])), m.gt_idx[rows], m.gt_word_idx[rows], found["gt_word"].take(some), pred[rows], found["pred_word"].take(some), found["cer"][rows], found["lev"][rows], found["correct"][rows])


def page_metrics_v1(rows: DataFrame, read: Reader, images: DataFrame) -> DataFrame:
    """metrics_v1 of the pages of rows dealt out by image_id."""
    sums = by_page(rows, read, metrics.page_sums, SUMS)
    return metrics.rates(images.select("image_id").distinct().join(sums, "image_id", "left"))


def metrics_v2(truth: Truth, predicted: Predicted) -> DataFrame:
    matches = matching.best_regions(predicted.regions, truth.regions)
    superbox = matching.superboxes(matches, truth.regions)
    order = matching.read_order(superbox, predicted.regions)
    texts = metrics.document_texts(order, superbox, truth.regions, predicted.regions)
    return metrics.metrics_v2(texts, truth.scored_images())


def summaries(v1: DataFrame) -> DataFrame:
    return metrics.summary_v1(v1)


def corpus_timings(runtimes: DataFrame) -> DataFrame:
    """(image_id, full_pipeline) from (image_id, stage, seconds)."""
    return runtimes.groupBy("image_id").agg(F.sum("seconds").alias("full_pipeline"))
