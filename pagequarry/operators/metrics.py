"""Scores of recognised words and documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagequarry.functions.text import document_cer, document_wer, edits, f1, gt_word, permutation_of, plain_gt_word, shuffled, word_distance, word_ned
from pagequarry.operators.matching import Matched, Pages

REGION = ["image_id", "gt_idx"]


def word_scores(gt_words: DataFrame, pred_words: DataFrame, matches: DataFrame) -> DataFrame:
    """A row for each scored ground-truth word of a region: its match, NED and distance; words with Latin letters or digits are left out."""
    texts = pred_words.select(*REGION, "pred_word_idx", F.col("text").alias("pred_text"))
    rows = gt_words.select(*REGION, "gt_word_idx", "text").join(matches.select(*REGION, "gt_word_idx", "pred_word_idx"), [*REGION, "gt_word_idx"], "left")
    return scored_words(rows.join(texts, [*REGION, "pred_word_idx"], "left"))


def scored_words(matches: DataFrame) -> DataFrame:
    """word_scores of ground-truth words that come with their match: (image_id, gt_idx, gt_word_idx, text, pred_word_idx, pred_text)."""
    rows = matches.withColumn("gt_word", gt_word(F.col("text"))).where(F.col("gt_word").isNotNull())
    pred = F.coalesce("pred_text", F.lit(""))
    return rows.select(
        "image_id",
        F.col("gt_idx").alias("dla_box_idx"),
        "gt_word_idx",
        "gt_word",
        F.coalesce("pred_word_idx", F.lit(-1)).alias("pred_word_idx"),
        pred.alias("pred_word"),
        word_ned(F.col("gt_word"), pred).alias("cer"),
        word_distance(F.col("gt_word"), pred).alias("lev"),
        (F.col("pred_text").isNotNull() & (F.col("pred_text") == F.col("gt_word"))).alias("correct"),
    )


def image_sums(matches: DataFrame) -> DataFrame:
    """(image_id, n, cer, correct, matched): sums of scored_words, and predicted words that have a partner, in one pass over word_matches with texts."""
    word, pred = gt_word(F.col("text")), F.coalesce("pred_text", F.lit(""))
    rows = matches.select("image_id", "by_pred", "pred_text", word.alias("gt_word"), F.when(word.isNotNull(), word_ned(word, pred)).alias("cer"))
    sums = rows.groupBy("image_id").agg(F.count("gt_word").alias("n"), F.sum("cer").alias("cer"), F.count_if(F.col("pred_text") == F.col("gt_word")).alias("correct"), F.count("by_pred").alias("matched"))
    return sums.withColumns({"n": F.nullif("n", F.lit(0)), "matched": F.nullif("matched", F.lit(0))})


#: Pairs of words whose distance a Python worker remembers.
KNOWN_PAIRS = 200_000
_known: dict[tuple[str, str], tuple[float, int]] = {}


def pair_score(gt: str, pred: str) -> tuple[float, int]:
    """(word_ned, word_distance) of two words."""
    found = _known.get((gt, pred))
    if found is None:
        n = edits(gt, pred)
        found = (n / max(len(gt), len(pred)) if gt and pred else 1.0), n
        if len(_known) >= KNOWN_PAIRS:
            _known.clear()
        _known[gt, pred] = found
    return found


def scored_texts(texts: pa.Array) -> pa.Array:
    """gt_word of texts, which for printable signs is the text itself."""
    signs = pc.match_substring_regex(texts, "^[!-/:-@\\[-`{-~]*$")
    rest = pc.invert(signs).to_numpy(zero_copy_only=False)
    latin = pc.match_substring_regex(texts, "[A-Za-z0-9]").to_numpy(zero_copy_only=False)
    other = np.flatnonzero(rest & ~latin)
    places = np.arange(len(texts))
    places[other] = len(texts) + np.arange(len(other))
    plain = pa.array([plain_gt_word(x) for x in texts.take(pa.array(other)).to_pylist()], pa.string())
    return pa.concat_arrays([texts, plain]).take(pa.array(places, mask=latin))


def page_scores(pages: Pages, found: Matched) -> dict[str, pa.Array | np.ndarray]:
    """Columns of scored_words, a row for each of `found`, gt_word null where a word is not scored: each different pair of words is compared once."""
    gt = pages.gt_words.text.take(pa.array(found.word)).dictionary_encode()
    partner = pa.array(np.append(found.pred, 0)[found.by_gt], mask=found.by_gt < 0)
    pred = pages.pred_words.text.take(partner).dictionary_encode()
    null = pa.array([None], pa.string())
    words, texts = pa.concat_arrays([scored_texts(gt.dictionary), null]), pa.concat_arrays([pred.dictionary, null])
    g, p = (pc.fill_null(x.indices, len(t) - 1).to_numpy(zero_copy_only=False).astype(np.int64) for x, t in ((gt, words), (pred, texts)))
    pairs = pa.array(g * len(texts) + p).dictionary_encode()
    which = pairs.indices.to_numpy(zero_copy_only=False)
    a, b = (x.take(pa.array(i)) for x, i in zip((words, texts), np.divmod(pairs.dictionary.to_numpy(), len(texts)), strict=True))
    same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    scores = np.zeros((len(same), 2))
    compared = np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False) & ~(same & pc.fill_null(pc.not_equal(a, ""), False).to_numpy(zero_copy_only=False)))
    for i, word, text in zip(compared.tolist(), *(x.take(pa.array(compared)).to_pylist() for x in (a, b)), strict=True):
        scores[i] = pair_score(word, text or "")
    cer, lev = scores[which].T
    return {"gt_word": words.take(pa.array(g)), "pred_word": pc.fill_null(texts.take(pa.array(p)), ""), "cer": cer, "lev": lev.astype(np.int32), "correct": same[which]}


def page_sums(pages: Pages, found: Matched) -> pa.RecordBatch:
    """image_sums of many images at once."""
    rows = page_scores(pages, found)
    scored = rows["gt_word"].is_valid().to_numpy(zero_copy_only=False)
    total = lambda values: np.bincount(found.image, weights=values, minlength=len(pages.images))
    n, correct, matched = (total(x).astype(np.int64) for x in (scored, rows["correct"], found.by_pred >= 0))
    whole = lambda x: pa.array(x, pa.int64(), mask=x == 0)
    return pa.RecordBatch.from_arrays([pages.images, whole(n), pa.array(total(rows["cer"]), pa.float64(), mask=n == 0), pa.array(correct), whole(matched)], names=["image_id", "n", "cer", "correct", "matched"])


def matched_counts(matches: DataFrame) -> DataFrame:
    """(image_id, matched): predicted words that have a partner."""
    return matches.groupBy("image_id").agg(F.count(F.lit(1)).alias("matched"))


def metrics_v1(scores: DataFrame, matched: DataFrame, images: DataFrame) -> DataFrame:
    """Word metrics of every image. Without scored words: NED 0 and accuracy 1; without matched predictions: precision 1."""
    sums = scores.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cer").alias("cer"), F.count_if("correct").alias("correct"))
    return rates(images.select("image_id").join(sums, "image_id", "left").join(matched, "image_id", "left"))


def rates(rows: DataFrame) -> DataFrame:
    """metrics_v1 of images with their sums (n, cer, correct, matched), each null or none if there are none."""
    share = lambda a, b, empty: F.coalesce(F.try_divide(F.coalesce(a, F.lit(0)).cast("double"), b.cast("double")), F.lit(empty))
    rows = rows.select(
        F.col("image_id").alias("file_stem"),
        share(F.col("cer"), F.col("n"), 0.0).alias("average_NED"),
        share(F.col("correct"), F.col("n"), 1.0).alias("average_accuracy"),
        share(F.col("correct"), F.col("matched"), 1.0).alias("average_precision"),
    )
    return rows.withColumn("average_f1", f1(F.col("average_precision"), F.col("average_accuracy")))


def summary_v1(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation over documents."""
    return metrics.agg(*[f(c).alias(f"{label}_{c}") for c in ("average_NED", "average_accuracy") for label, f in (("mean", F.avg), ("std", F.stddev_samp))])


def document_texts(read_order: DataFrame, superbox: DataFrame, gt_texts: DataFrame, pred_texts: DataFrame, separator: str = "\n") -> DataFrame:
    """(image_id, reference, hypothesis): region texts in the seeded order, for regions with ground-truth text."""
    joined = read_order.join(pred_texts.select("image_id", "pred_idx", F.coalesce("region_text", F.lit("")).alias("t")), ["image_id", "pred_idx"], "left")
    hyps = joined.groupBy(*REGION).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("member", F.coalesce("t", F.lit("")).alias("t")))), lambda m: m["t"]), " ").alias("hyp"))
    rows = superbox.select(*REGION, "place").join(gt_texts.select(*REGION, F.col("text").alias("ref")), REGION).where(F.length("ref") > 0)
    rows = rows.join(hyps, REGION, "left").withColumn("hyp", F.coalesce("hyp", F.lit("")))
    docs = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("place", "ref", "hyp"))).alias("r"))
    docs = docs.withColumn("o", permutation_of(F.size("r")))
    side = lambda name: F.array_join(F.transform(shuffled(F.col("r"), F.col("o")), lambda r: r[name]), separator)
    return docs.select("image_id", side("ref").alias("reference"), side("hyp").alias("hypothesis"))


def metrics_v2(texts: DataFrame, images: DataFrame) -> DataFrame:
    """Character and word error rates of whole documents; null without reference text."""
    rates = texts.select("image_id", document_cer(F.col("reference"), F.col("hypothesis")).alias("doc_cer"), document_wer(F.col("reference"), F.col("hypothesis")).alias("doc_wer"))
    return images.select("image_id").join(rates, "image_id", "left").select(F.col("image_id").alias("file_stem"), "doc_cer", "doc_wer")


def runtime_total(stages: Column) -> Column:
    """Sum of a map of stage seconds."""
    return F.aggregate(F.map_values(stages), F.lit(0.0), lambda total, s: total + s)


def running_mean(runtimes: DataFrame, value: str, order: list[str], partition: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Mean of all rows up to each, within `partition`; sums are rounded to `digits`, so the order of additions does not show."""
    w = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runtimes.withColumn("running_mean", F.round(F.sum(value).over(w), digits) / F.count(value).over(w))
