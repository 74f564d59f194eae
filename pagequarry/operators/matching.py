"""Joins of predictions with ground truth: overlaps by cells, best matches, one-to-one matches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagequarry.functions.geometry import Box, intersection, iou, overlap_ratio


def cells(boxes: DataFrame, cell: float) -> DataFrame:
    """Boxes, once for each cell of the page grid that they touch."""
    b = Box.of().ordered()
    at = lambda c: F.floor(c / F.lit(float(cell))).cast("int")
    rows = boxes.withColumn("_cx", F.explode(F.sequence(at(b.x0), at(b.x1))))
    return rows.withColumn("_cy", F.explode(F.sequence(at(b.y0), at(b.y1))))


def grid_pairs(left: DataFrame, right: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Pairs of boxes with equal keys that overlap, columns prefixed l_ and r_ but for the keys.

    Both sides are dealt to cells, so pages of many boxes are compared by neighbourhood. A pair counts in the one cell that
    holds the corner where the overlap begins, so none is met twice.
    """
    side = lambda df, p: cells(df, cell).select(*keys, "_cx", "_cy", *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys))
    pairs = side(left, "l").join(side(right, "r"), [*keys, "_cx", "_cy"])
    a, b = Box.of("l_").ordered(), Box.of("r_").ordered()
    corner = lambda u, v: F.floor(F.greatest(u, v) / F.lit(float(cell))).cast("int")
    first = (corner(a.x0, b.x0) == F.col("_cx")) & (corner(a.y0, b.y0) == F.col("_cy"))
    return pairs.where(first & (intersection(Box.of("l_"), Box.of("r_")) > 0)).drop("_cx", "_cy")


def best_regions(pred: DataFrame, gt: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every predicted region (image_id, pred_idx, x0..) with the ground-truth region (gt_idx) that covers most of it, if over `threshold`; ties go to the lower index; else -1."""
    g = gt.select(F.col("image_id").alias("_image"), "gt_idx", *(F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")))
    pairs = pred.join(g, F.col("image_id") == F.col("_image"), "left").withColumn("ratio", overlap_ratio(Box.of("g_"), Box.of()))
    best = pairs.groupBy("image_id", "pred_idx").agg(F.max(F.when(F.col("ratio") > threshold, F.struct("ratio", (-F.col("gt_idx")).alias("low")))).alias("m"))
    return best.select("image_id", "pred_idx", F.coalesce((-F.col("m.low")).cast("int"), F.lit(-1)).alias("gt_idx"), F.col("m.ratio").alias("ratio"))


def words_in_regions(words: DataFrame, regions: DataFrame, threshold: float = 0.5, least_area: float = 1e-5) -> DataFrame:
    """(image_id, gt_idx, word_pos, gt_word_idx, ...): words of which over `threshold` lies in a region, renumbered in it; a word may lie in several."""
    r = regions.select(F.col("image_id").alias("_image"), "gt_idx", *(F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")))
    rows = words.where(Box.of().area() >= least_area).join(r, F.col("image_id") == F.col("_image"))
    rows = rows.where(overlap_ratio(Box.of("g_"), Box.of()) > threshold).drop("_image", "g_x0", "g_y0", "g_x1", "g_y1")
    order = Window.partitionBy("image_id", "gt_idx").orderBy("word_pos")
    return rows.withColumn("gt_word_idx", (F.row_number().over(order) - 1).cast("int"))


def of_image(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(_image, name): a map of each image from `key` to the sorted values with it, so that joins by image do for joins by image and key."""
    lists = rows.groupBy("image_id", key).agg(F.sort_array(F.collect_list(value)).alias("_values"))
    return lists.groupBy(F.col("image_id").alias("_image")).agg(F.map_from_entries(F.collect_list(F.struct(key, "_values"))).alias(name))


def superboxes(matches: DataFrame, gt: DataFrame) -> DataFrame:
    """Each ground-truth region with the predicted regions matched to it, in order of index, and its place: by first match, unmatched ones last."""
    found = of_image(matches.where("gt_idx <> -1"), "gt_idx", F.col("pred_idx"), "_found")
    rows = gt.select("image_id", "gt_idx").join(found, F.col("image_id") == F.col("_image"), "left")
    rows = rows.select("image_id", "gt_idx", F.col("_found")[F.col("gt_idx")].alias("preds"))
    order = Window.partitionBy("image_id").orderBy(F.get("preds", F.lit(0)).asc_nulls_last(), "gt_idx")
    return rows.withColumns({"place": (F.row_number().over(order) - 1).cast("int"), "preds": F.coalesce("preds", F.array().cast("array<int>"))})


def read_order(superbox: DataFrame, pred: DataFrame) -> DataFrame:
    """Superboxes with members in order of their centre's y, then index: (image_id, gt_idx, place, pred_idx, member)."""
    members = superbox.select("image_id", "gt_idx", "place", F.explode("preds").alias("pred_idx"))
    middle = of_image(pred, "pred_idx", Box.of().centroid()[1], "_middle")
    rows = members.join(middle, F.col("image_id") == F.col("_image")).select(*members.columns, F.explode(F.col("_middle")[F.col("pred_idx")]).alias("_cy"))
    order = Window.partitionBy("image_id", "gt_idx").orderBy("_cy", "pred_idx")
    return rows.withColumn("member", (F.row_number().over(order) - 1).cast("int")).drop("_cy")


def merged_words(words: DataFrame, superbox: DataFrame) -> DataFrame:
    """Predicted words of each ground-truth region, numbered through its superbox: pred region, line, word."""
    members = superbox.select("image_id", "gt_idx", F.explode("preds").alias("pred_idx"))
    regions = of_image(members, "pred_idx", F.col("gt_idx"), "_regions")
    order = Window.partitionBy("image_id", "gt_idx").orderBy("pred_idx", "line_idx", "word_idx")
    rows = words.join(regions, F.col("image_id") == F.col("_image"))
    rows = rows.select(*words.columns, F.explode(F.col("_regions")[F.col("pred_idx")]).alias("gt_idx"))
    return rows.withColumn("pred_word_idx", (F.row_number().over(order) - 1).cast("int"))


def match_candidates(pred: DataFrame, gt: DataFrame, threshold: float = 0.5, cell: float = 64.0) -> DataFrame:
    """(image_id, gt_idx, pred_word_idx, gt_word_idx, iou) of word pairs of a region that overlap by over `threshold`."""
    p = pred.select("image_id", "gt_idx", "pred_word_idx", "x0", "y0", "x1", "y1")
    g = gt.select("image_id", "gt_idx", "gt_word_idx", "x0", "y0", "x1", "y1")
    pairs = grid_pairs(p, g, ["image_id", "gt_idx"], cell).withColumn("iou", iou(Box.of("l_"), Box.of("r_")))
    return pairs.where(F.col("iou") > threshold).select("image_id", "gt_idx", F.col("l_pred_word_idx").alias("pred_word_idx"), F.col("r_gt_word_idx").alias("gt_word_idx"), "iou")


def greedy_matches(candidates: DataFrame, pivot: str, other: str, keys: list[str]) -> DataFrame:
    """One-to-one matches: pivots in order of index take their best free partner (greatest iou, then lowest index).

    Candidates are sorted once by key and preference; a pass over each sorted partition keeps the partners taken in the region at
    hand, and nothing else, in memory.
    """
    rows = candidates.select(*keys, pivot, other, "iou")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, matched, taken = None, None, set()
        for batch in batches:
            keep = []
            for *key, p, o in zip(*(batch.column(i).to_pylist() for i in range(len(keys) + 2)), strict=True):
                if key != region:
                    region, matched, taken = key, None, set()
                free = p != matched and o not in taken
                keep.append(free)
                if free:
                    matched = p
                    taken.add(o)
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, pivot, F.desc("iou"), other)
    return ordered.mapInArrow(choose, rows.schema)


def cell_keys(key: np.ndarray, box: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """For every cell that a box (corners in order) touches: the box's place, and (key, x, y) of the cell."""
    lo, hi = np.floor(box[:, :2] / cell).astype(np.int64), np.floor(box[:, 2:] / cell).astype(np.int64)
    wide, high = (hi - lo + 1).T
    n = wide * high
    at = np.repeat(np.arange(len(box)), n)
    k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, np.stack([key[at], lo[at, 0] + k % wide[at], lo[at, 1] + k // wide[at]], axis=1)


def image_candidates(pred: tuple[np.ndarray, np.ndarray], gt: tuple[np.ndarray, np.ndarray], threshold: float, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of an image's predicted and ground-truth boxes (key, corners) of equal key that overlap by over `threshold`, and how much: match_candidates of one image."""
    (pk, pb), (gk, gb) = ((k, np.stack([np.minimum(b[:, 0], b[:, 2]), np.minimum(b[:, 1], b[:, 3]), np.maximum(b[:, 0], b[:, 2]), np.maximum(b[:, 1], b[:, 3])], axis=1)) for k, b in (pred, gt))
    (p, pc), (g, gc) = cell_keys(pk, pb, cell), cell_keys(gk, gb, cell)
    both = np.concatenate([pc, gc])
    code = np.zeros(len(both), dtype=np.int64)
    for c in both.T:
        values, rank = np.unique(c, return_inverse=True)
        code = code * len(values) + rank
    order = np.argsort(code[len(p) :], kind="stable")
    known = code[len(p) :][order]
    first = np.searchsorted(known, code[: len(p)])
    n = np.searchsorted(known, code[: len(p)], "right") - first
    row = np.repeat(np.arange(len(p)), n)
    g = g[order[np.repeat(first, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]]
    p, at = p[row], pc[row, 1:]
    a, b = pb[p], gb[g]
    corner = np.maximum(a[:, :2], b[:, :2])
    side = np.maximum(np.minimum(a[:, 2:], b[:, 2:]) - corner, 0)
    shared = side[:, 0] * side[:, 1]
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    keep = (np.floor(corner / cell).astype(np.int64) == at).all(axis=1) & (shared > 0)
    p, g, a, b, shared = p[keep], g[keep], a[keep], b[keep], shared[keep]
    ratio = shared / (area(a) + area(b) - shared)
    good = ratio > threshold
    return p[good], g[good], ratio[good]


def greedy_partners(key: np.ndarray, pivot: np.ndarray, other: np.ndarray, ratio: np.ndarray) -> list[int]:
    """Which candidates greedy_matches keeps, in its order."""
    region, matched, taken, keep = None, None, set(), []
    order = np.lexsort([other, -ratio, pivot, key])
    for i, k, p, o in zip(order.tolist(), key[order].tolist(), pivot[order].tolist(), other[order].tolist(), strict=True):
        if k != region:
            region, matched, taken = k, None, set()
        if p != matched and o not in taken:
            matched = p
            taken.add(o)
            keep.append(i)
    return keep


def word_matches(pred: DataFrame, gt: DataFrame, texts: bool = False, threshold: float = 0.5, cell: float = 64.0) -> DataFrame:
    """Every ground-truth word (image_id, gt_idx, gt_word_idx) with its partner if ground-truth words choose (pred_word_idx, iou) and if predicted ones do (by_pred, by_pred_iou), else null; with `texts`, those of the word and the former partner.

    The matches of match_candidates and greedy_matches. Both sides meet by image, whose words one task holds, so tables dealt out
    by image stay where they are. Words without a whole box match nothing.
    """
    box = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    side = lambda df, image, idx: df.select(F.col("image_id").alias(image), *(F.col(c).alias(c) for c in ("gt_idx", idx)), *box, *([F.col("text").alias("text")] if texts else []))

    def match(g: pa.Table, p: pa.Table) -> pa.Table:
        def read(t: pa.Table, idx: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            corners = np.stack([t.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1)
            rows = np.flatnonzero(np.isfinite(corners).all(axis=1))
            return rows, t.column("gt_idx").to_numpy()[rows], t.column(idx).to_numpy()[rows], corners[rows]

        (grow, gk, gi, gb), (prow, pk, pi, pb) = read(g, "gt_word_idx"), read(p, "pred_word_idx")
        out = {c: g.column(c) for c in ("image_id", "gt_idx", "gt_word_idx")}
        a, b, ratio = image_candidates((pk, pb), (gk, gb), threshold, cell)
        for names, pivot, other in ((("pred_word_idx", "iou"), gi[b], pi[a]), (("by_pred", "by_pred_iou"), pi[a], gi[b])):
            keep = np.array(greedy_partners(gk[b], pivot, other, ratio), dtype=np.int64)
            partner, much = np.zeros(g.num_rows, dtype=np.int64), np.zeros(g.num_rows)
            none = np.ones(g.num_rows, dtype=bool)
            at = grow[b[keep]]
            partner[at], much[at], none[at] = prow[a[keep]], ratio[keep], False
            places = pa.array(partner, mask=none)
            out[names[0]], out[names[1]] = p.column("pred_word_idx").take(places), pa.array(much, mask=none)
            if texts and names[0] == "pred_word_idx":
                out |= {"text": g.column("text"), "pred_text": p.column("text").take(places)}
        return pa.table(out).select(names_out)

    ddl = "image_id string, gt_idx int, gt_word_idx int, pred_word_idx int, iou double, by_pred int, by_pred_iou double" + (", text string, pred_text string" if texts else "")
    names_out = [c.split()[0] for c in ddl.split(", ")]
    g, p = side(gt, "image_id", "gt_word_idx"), side(pred, "_image", "pred_word_idx")
    return g.groupBy("image_id").cogroup(p.groupBy("_image")).applyInArrow(match, ddl)


# many images at once ----------------------------------------------------------------------------------------------------

#: Pairs of boxes that are compared at a time.
PAIRS = 1 << 21


@dataclass(frozen=True)
class Boxes:
    """Boxes of many images: the number of each one's image, its index there, its corners, and its text if it has one."""

    image: np.ndarray
    index: np.ndarray
    box: np.ndarray
    text: pa.Array | None = None


@dataclass(frozen=True)
class Pages:
    """Images with their boxes, by number of the image; indices are gt_idx, word_pos, pred_idx, and (pred_idx, line_idx, word_idx)."""

    images: pa.Array
    gt_regions: Boxes
    gt_words: Boxes
    pred_regions: Boxes
    pred_words: Boxes


@dataclass(frozen=True)
class Matched:
    """Ground-truth words in regions (place of the word, image, gt_idx, gt_word_idx), predicted words of superboxes (place, pred_word_idx),
    and the place among the latter of each ground-truth word's partner, or -1, with their overlap, if ground-truth words choose and if predicted ones do."""

    word: np.ndarray
    image: np.ndarray
    gt_idx: np.ndarray
    gt_word_idx: np.ndarray
    pred: np.ndarray
    pred_word_idx: np.ndarray
    by_gt: np.ndarray
    by_gt_iou: np.ndarray
    by_pred: np.ndarray
    by_pred_iou: np.ndarray


def in_order(box: np.ndarray) -> np.ndarray:
    """Inverted corners put right."""
    return np.concatenate([np.minimum(box[:, :2], box[:, 2:]), np.maximum(box[:, :2], box[:, 2:])], axis=1)


def whole_boxes(box: np.ndarray) -> np.ndarray:
    """Places of boxes whose four corners are finite."""
    return np.flatnonzero(np.logical_and.reduce([np.isfinite(c) for c in box.T]))


def areas(box: np.ndarray) -> np.ndarray:
    return (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])


def one_code(columns: np.ndarray) -> np.ndarray:
    """A number for each different row."""
    low = [int(c.min()) if len(c) else 0 for c in columns.T]
    span = [int(c.max()) - least + 1 if len(c) else 1 for c, least in zip(columns.T, low, strict=True)]
    whole = 1
    for x in span:
        whole *= x
    code = np.zeros(len(columns), dtype=np.int64)
    for c, n, least in zip(columns.T, span, low, strict=True):
        values, n = (c - least, n) if whole < 1 << 62 else ((u := np.unique(c, return_inverse=True))[1], len(u[0]))
        code = code * n + values
    return code


def overlaps(a_key: np.ndarray, a: np.ndarray, b_key: np.ndarray, b: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in a, place in b, shared area) of boxes, corners in order, of equal key that overlap, each pair once, PAIRS compared at a time.

    As in grid_pairs, boxes are dealt to cells, and a pair counts where its overlap begins; cells are of one (width, height), or of one for each key. Boxes that are not finite overlap nothing.
    """
    (p, pc), (g, gc) = (dealt_to_cells(k, x, cell) for k, x in ((a_key, a), (b_key, b)))
    code = one_code(np.concatenate([pc, gc]))
    order = np.argsort(code[len(p) :], kind="stable")
    known = code[len(p) :][order]
    g = g[order]
    first = np.searchsorted(known, code[: len(p)])
    n = np.searchsorted(known, code[: len(p)], "right") - first
    found = np.flatnonzero(n)
    p, at, first, n = p[found], pc[found, 1:], first[found], n[found]
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = (np.ascontiguousarray(x.T) for x in (a[p], b[g]))
    ends = np.cumsum(n)
    lo = done = 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        x = np.repeat(np.arange(lo, hi), n[lo:hi])
        y = np.arange(len(x)) + np.repeat(first[lo:hi] - (ends[lo:hi] - n[lo:hi] - done), n[lo:hi])
        top = np.maximum(ay0[x], by0[y])
        height = np.minimum(ay1[x], by1[y]) - top
        meet = np.flatnonzero(height > 0)
        x, y, top, height = x[meet], y[meet], top[meet], height[meet]
        left = np.maximum(ax0[x], bx0[y])
        width = np.minimum(ax1[x], bx1[y]) - left
        w, h = cell if cell.ndim == 1 else cell[a_key[p[x]]].T
        begins = np.flatnonzero((width > 0) & (np.floor(left / w) == at[x, 0]) & (np.floor(top / h) == at[x, 1]))
        yield p[x[begins]], g[y[begins]], width[begins] * height[begins]
        lo, done = hi, int(ends[hi - 1])


def dealt_to_cells(key: np.ndarray, box: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cell_keys of the finite boxes, with cells that may differ by key."""
    rows = whole_boxes(box)
    at, cells = cell_keys(key[rows], box[rows] / np.tile(cell if cell.ndim == 1 else cell[key[rows]], 2), 1.0)
    return rows[at], cells


def mean_size(box: np.ndarray) -> np.ndarray:
    """Mean width and height of finite boxes, at least 16."""
    whole = box[whole_boxes(box)]
    return np.maximum((whole[:, 2:] - whole[:, :2]).mean(axis=0), 16.0) if len(whole) else np.full(2, 16.0)


def page_cells(images: int, regions: Boxes, box: np.ndarray) -> np.ndarray:
    """Mean width and height of each image's regions, at least 16."""
    whole = whole_boxes(box)
    n = np.maximum(np.bincount(regions.image[whole], minlength=images), 1)
    size = (box[:, 2:] - box[:, :2])[whole]
    return np.maximum(np.stack([np.bincount(regions.image[whole], weights=size[:, i], minlength=images) / n for i in (0, 1)], axis=1), 16.0)


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def numbered(new: np.ndarray) -> np.ndarray:
    """Number of each row since the last new one, from 0."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(new) else at


def greedy_rows(pivot: np.ndarray, other: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Which candidates greedy_matches keeps, of pivots and others numbered in the order of their key and index.

    Where all pivots of a partner have no other candidate the first one takes it, and where all candidates of a pivot have no other pivot it takes the best;
    only what hangs together otherwise is gone through in order.
    """
    if not len(pivot):
        return np.empty(0, dtype=np.int64)
    of_pivot, of_other = np.bincount(pivot)[pivot], np.bincount(other)[other]
    about_other = np.bincount(other, weights=of_pivot == 1)[other] == of_other
    about_pivot = ~about_other & (np.bincount(pivot, weights=of_other == 1)[pivot] == of_pivot)
    kept = [np.flatnonzero(about_other & (of_other == 1))]
    rows = np.flatnonzero(about_other & (of_other > 1))
    rows = rows[np.lexsort([pivot[rows], other[rows]])]
    kept.append(rows[firsts(other[rows])])
    rows = np.flatnonzero(about_pivot)
    rows = rows[np.lexsort([other[rows], -ratio[rows], pivot[rows]])]
    kept.append(rows[firsts(pivot[rows])])
    rest = np.flatnonzero(~about_other & ~about_pivot)
    kept.append(rest[np.array(greedy_partners(np.zeros(len(rest), dtype=np.int64), pivot[rest], other[rest], ratio[rest]), dtype=np.int64)])
    return np.concatenate(kept)


def page_matches(pages: Pages, threshold: float = 0.5, least_area: float = 1e-5) -> Matched:
    """best_regions, words_in_regions, merged_words and word_matches of many images at once, as arrays: the same rows without a table between them."""
    gt, words, pred, found = pages.gt_regions, pages.gt_words, pages.pred_regions, pages.pred_words
    gt_box, word_box, pred_box, found_box = (in_order(x.box) for x in (gt, words, pred, found))
    cells = page_cells(len(pages.images), gt, gt_box)
    joined = lambda parts: tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def over(part: tuple[np.ndarray, ...], area: np.ndarray) -> tuple[np.ndarray, ...]:
        keep = np.flatnonzero(part[2] / area[part[0]] > threshold)
        return part[0][keep], part[1][keep], part[2][keep] / area[part[0][keep]]

    none = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
    area = areas(pred_box)
    p, g, ratio = joined([none, *(over(x, area) for x in overlaps(pred.image, pred_box, gt.image, gt_box, cells))])
    order = np.lexsort([gt.index[g], -ratio, p])
    best = order[firsts(p[order])]
    region = np.full(len(pred.index), -1, dtype=np.int64)
    region[p[best]] = gt.index[g[best]]

    area = areas(word_box)
    big = np.flatnonzero(area >= least_area)
    w, g, _ = joined([none, *((big[x[0]], *x[1:]) for x in (over(x, area[big]) for x in overlaps(words.image[big], word_box[big], gt.image, gt_box, cells)))])
    order = np.lexsort([words.index[w], gt.index[g], words.image[w]])
    w, image, gt_idx = w[order], words.image[w[order]], gt.index[g[order]]
    gt_word_idx = numbered(firsts(image, gt_idx))

    known = one_code(np.concatenate([np.stack([x, y], axis=1) for x, y in ((pred.image, pred.index), (found.image, found.index[:, 0]))]))
    by_code = np.argsort(known[: len(region)], kind="stable")
    at = np.minimum(np.searchsorted(known[: len(region)][by_code], known[len(region) :]), max(len(region) - 1, 0))
    its = by_code[at] if len(region) else np.zeros(len(found.image), dtype=np.int64)
    member = (known[its] == known[len(region) :]) & (region[its] >= 0) if len(region) else np.zeros(len(found.image), dtype=bool)
    m = np.flatnonzero(member)
    m = m[np.lexsort([*found.index[m].T[::-1], region[its[m]], found.image[m]])]
    m_image, m_gt = found.image[m], region[its[m]]
    pred_word_idx = numbered(firsts(m_image, m_gt))

    key = one_code(np.concatenate([np.stack([image, gt_idx], axis=1), np.stack([m_image, m_gt], axis=1)]))
    pair_area, other_area = areas(found_box)[m], area[w]

    def alike(part: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        ratio = part[2] / (pair_area[part[0]] + other_area[part[1]] - part[2])
        keep = np.flatnonzero(ratio > threshold)
        return part[0][keep], part[1][keep], ratio[keep]

    b, a, ratio = joined([none, *(alike(x) for x in overlaps(key[len(w) :], found_box[m], key[: len(w)], word_box[w], 2 * mean_size(word_box)))])
    partners = []
    for kept in (greedy_rows(a, b, ratio), greedy_rows(b, a, ratio)):
        partner, much = np.full(len(w), -1, dtype=np.int64), np.zeros(len(w))
        partner[a[kept]], much[a[kept]] = b[kept], ratio[kept]
        partners += [partner, much]
    return Matched(w, image, gt_idx, gt_word_idx, m, pred_word_idx, *partners)
