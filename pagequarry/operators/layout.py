"""Layout operators on keyed tables: regions, lines and words of page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagequarry.functions.geometry import Box, class_name, line_box, overlap_ratio, padded_height, quad_corner, slice_length, to_page, top_padding, word_box
from pagequarry.operators.matching import grid_pairs
from pagequarry.schemas import TEXT_CLASSES

REGION = ["image_id", "region_idx"]
LINE = [*REGION, "line_idx"]


# regions ----------------------------------------------------------------------------------------------------------------


def project_regions(detections: DataFrame) -> DataFrame:
    """Region rows of detections: class name, normalised corners, and place and size in percent of the page."""
    n = Box.of().normalised(F.col("img_width").cast("double"), F.col("img_height").cast("double"))
    rows = detections.withColumns(n.named("n"))
    return rows.select(
        *REGION,
        "class_id",
        class_name(F.col("class_id")).alias("class"),
        *n.named("n"),
        (F.col("nx0") * 100).alias("left"),
        (F.col("ny0") * 100).alias("top"),
        ((F.col("ny1") - F.col("ny0")) * 100).alias("elem_height"),
        ((F.col("nx1") - F.col("nx0")) * 100).alias("elem_width"),
        "img_height",
        "img_width",
        F.lit("").alias("text"),
        F.lit(False).alias("single_line"),
        F.lit(None).cast("string").alias("img_src"),
    )


def pixel_boxes(regions: DataFrame) -> DataFrame:
    """Regions with whole-pixel corners px0, py0, px1, py1, from the normalised ones."""
    b = Box.of("n").scaled(F.col("img_width"), F.col("img_height")).outward()
    return regions.withColumns({"px0": b.x0, "py0": b.y0, "px1": b.x1, "py1": b.y1})


def suppress_overlaps(regions: DataFrame, box: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1"), threshold: float = 0.5, cell: float | None = None) -> DataFrame:
    """Drops a region if an earlier one of its page covers over `threshold` of it. Dropped regions still suppress others.

    With `cell`, pages are cut into cells of that size and only regions that share one are compared: for pages of very many regions.
    """
    if cell:
        named = regions.select(*REGION, *(F.col(c).alias(d) for c, d in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))
        pairs = grid_pairs(named, named, ["image_id"], cell).where("l_region_idx < r_region_idx")
        gone = pairs.where(overlap_ratio(Box.of("l_"), Box.of("r_")) > threshold).select("image_id", F.col("r_region_idx").alias("region_idx")).distinct()
        return regions.join(gone.hint("merge"), REGION, "left_anti")
    early = regions.select(F.col("image_id").alias("e_image"), F.col("region_idx").alias("e_idx"), *(F.col(c).alias(f"e_{d}") for c, d in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))
    later = Box(*(F.col(c) for c in box))
    covered = (F.col("image_id") == F.col("e_image")) & (F.col("e_idx") < F.col("region_idx")) & (overlap_ratio(Box.of("e_"), later) > threshold)
    return regions.join(early.hint("merge"), covered, "left_anti")


def is_text(kind: Column) -> Column:
    return kind.isin(*TEXT_CLASSES)


def padded_text_regions(regions: DataFrame, ratio: float = 1.2) -> DataFrame:
    """Text regions with pixel corners, and the size of their crop and its padding."""
    h = F.col("py1") - F.col("py0")
    rows = pixel_boxes(regions.where(is_text(F.col("class"))))
    return rows.withColumns({"pad_top": top_padding(h, ratio), "crop_h": padded_height(h, ratio), "crop_w": F.col("px1") - F.col("px0")})


def image_sources(regions: DataFrame, stem: Column, extension: Column) -> DataFrame:
    """Image regions get the relative path of their crop; the index is the detector's."""
    path = F.concat(F.lit("./img/"), stem, F.lit("_"), F.col("region_idx").cast("string"), F.lit("."), extension)
    return regions.withColumn("img_src", F.when(F.col("class") == "image", path).otherwise(F.col("img_src")))


# lines ------------------------------------------------------------------------------------------------------------------


def line_boxes(quads: DataFrame, regions: DataFrame) -> DataFrame:
    """Whole-pixel boxes of detected line quads, in the crop (x0..) and on the page (gx0..); lines in order of y0, then detection."""
    box = line_box("quad")
    known = regions.select(*REGION, "px0", "py0", "px1", "py1", "pad_top", "crop_h", "crop_w")
    rows = quads.join(known.hint("merge"), REGION).withColumns(box.named())
    rows = rows.withColumns(to_page(Box.of(), Box.of("p"), F.col("pad_top")).named("g"))
    order = Window.partitionBy(*REGION).orderBy("y0", "det_idx")
    return rows.withColumn("line_idx", (F.row_number().over(order) - 1).cast("int"))


def dilate_lines_vertically(lines: DataFrame, rate: float = 0.1) -> DataFrame:
    """Lines grow into half of the gap to their neighbours; the first also upwards and the last of several downwards by `rate` of its height.

    Needs y0, y1, crop_h and line_idx; adds dil_top and dil_bottom. The last line's height already includes its growth upwards, and
    a single line grows upwards only.
    """
    w = Window.partitionBy(*REGION).orderBy("line_idx")
    n = F.count(F.lit(1)).over(Window.partitionBy(*REGION))
    half = lambda gap: F.when(gap > 0, F.floor(gap / 2)).otherwise(0).cast("int")
    rows = lines.withColumns({"_below": F.coalesce(half(F.lead("y0").over(w) - F.col("y1")), F.lit(0)), "_above": F.coalesce(half(F.col("y0") - F.lag("y1").over(w)), F.lit(0)), "_n": n, "_at": F.row_number().over(w)})
    first, last = F.col("_at") == 1, (F.col("_at") == F.col("_n")) & (F.col("_n") > 1)
    up = ((F.col("y1") - F.col("y0")) * F.lit(rate)).cast("int")
    inside = F.col("y0") - up > 0
    rows = rows.withColumns({"dil_top": F.when(first & inside, up).when(first, F.col("y0")).otherwise(F.col("_above")), "_y0": F.when(first & inside, F.col("y0") - up).when(first, F.lit(0)).otherwise(F.col("y0") - F.col("_above"))})
    down = ((F.col("y1") - F.col("_y0")) * F.lit(rate)).cast("int")
    fits = F.col("y1") + down < F.col("crop_h")
    rows = rows.withColumns({"dil_bottom": F.when(last & fits, down).when(last, F.col("crop_h") - F.col("y1")).otherwise(F.col("_below")), "_y1": F.when(last & fits, F.col("y1") + down).when(last, F.col("crop_h")).otherwise(F.col("y1") + F.col("_below"))})
    return rows.withColumns({"y0": F.col("_y0").cast("int"), "y1": F.col("_y1").cast("int"), "dil_top": F.col("dil_top").cast("int"), "dil_bottom": F.col("dil_bottom").cast("int")}).drop("_below", "_above", "_n", "_at", "_y0", "_y1")


def dilate_lines_horizontally(lines: DataFrame, rate: float = 0.3) -> DataFrame:
    """Lines grow sideways by `rate` of their height, within the crop's width; adds dil_left and dil_right."""
    pad = ((F.col("y1") - F.col("y0")) * F.lit(rate)).cast("int")
    left, right = F.col("x0") - pad > 0, F.col("x1") + pad < F.col("crop_w")
    rows = lines.withColumns({"dil_left": F.when(left, pad).otherwise(F.col("x0")).cast("int"), "dil_right": F.when(right, pad).otherwise(F.col("crop_w") - F.col("x1")).cast("int")})
    return rows.withColumns({"x0": F.when(left, F.col("x0") - pad).otherwise(F.lit(0)).cast("int"), "x1": F.when(right, F.col("x1") + pad).otherwise(F.col("crop_w")).cast("int")})


def apply_dilations(lines: DataFrame) -> DataFrame:
    """The page boxes (gx0..) grow as the crop boxes did."""
    return lines.withColumns({"gy0": F.col("gy0") - F.col("dil_top"), "gy1": F.col("gy1") + F.col("dil_bottom"), "gx0": F.col("gx0") - F.col("dil_left"), "gx1": F.col("gx1") + F.col("dil_right")})


def nonempty_crops(lines: DataFrame) -> DataFrame:
    """Lines whose crop has rows; its width is not asked for."""
    return lines.where(slice_length(F.col("y0"), F.col("y1"), F.col("crop_h")) > 0)


def single_lines(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Regions of exactly one line are marked, and their element is half as high again."""
    counts = lines.groupBy(*REGION).agg(F.count(F.lit(1)).alias("_n"))
    one = F.coalesce(F.col("_n") == 1, F.lit(False))
    rows = regions.join(counts.hint("merge"), REGION, "left")
    return rows.withColumns({"single_line": one, "elem_height": F.when(one, F.col("elem_height") * 1.5).otherwise(F.col("elem_height"))}).drop("_n")


# words ------------------------------------------------------------------------------------------------------------------


def word_boxes(quads: DataFrame) -> DataFrame:
    """Bounding boxes of word quads of a line; words in order of the quad's first x, then detection."""
    order = Window.partitionBy(*LINE).orderBy(quad_corner("quad", 0), "det_idx")
    return quads.withColumns(word_box("quad").named()).withColumn("word_idx", (F.row_number().over(order) - 1).cast("int"))


def dilate_words(words: DataFrame, ratio: float = 1.1, vertical: bool = True) -> DataFrame:
    """Neighbouring words share the gap between them; all but the last word grow up and down by `ratio` of their height.

    Needs x0..y1, word_idx and the line crop's line_h and line_w. Adds the crop that the recogniser reads (cx0..cy1): a word but
    the last one is cut at its own height, the last at its final box; without `vertical` only the last word has a crop.
    """
    w = Window.partitionBy(*LINE).orderBy("word_idx")
    half = lambda gap: F.when(gap > 0, F.floor(gap / 2))
    width, height = F.col("line_w").cast("double"), F.col("line_h").cast("double")
    rows = words.withColumns({"_right": half(F.lead("x0").over(w) - F.col("x1")), "_left": half(F.col("x0") - F.lag("x1").over(w)), "_last": F.lead("word_idx").over(w).isNull()})
    x0 = F.when(F.col("_left").isNotNull(), F.greatest(F.col("x0") - F.col("_left"), F.lit(0.0))).otherwise(F.col("x0"))
    x1 = F.when(F.col("_right").isNotNull(), F.least(F.col("x1") + F.col("_right"), width)).otherwise(F.col("x1"))
    pad = ((F.col("y1") - F.col("y0")) * F.lit(ratio)).cast("int")
    grows = ~F.col("_last") if vertical else F.lit(False)
    rows = rows.withColumns({"_x0": x0, "_x1": x1, "_y0": F.when(grows, F.greatest(F.col("y0") - pad, F.lit(0.0))).otherwise(F.col("y0")), "_y1": F.when(grows, F.least(F.col("y1") + pad, height)).otherwise(F.col("y1"))})
    cropped = F.col("_last") | F.lit(vertical)
    crop = {"cx0": F.col("_x0"), "cy0": F.col("y0"), "cx1": F.col("_x1"), "cy1": F.col("y1")}
    rows = rows.withColumns({k: F.when(cropped, c.cast("int")) for k, c in crop.items()})
    rows = rows.withColumns({c: F.col(f"_{c}") for c in ("x0", "y0", "x1", "y1")}).drop("_right", "_left", "_last", "_x0", "_x1", "_y0", "_y1")
    size = lambda lo, hi, n: slice_length(F.col(lo), F.col(hi), F.col(n))
    return rows.withColumn("crop_ok", F.coalesce((size("cx0", "cx1", "line_w") > 0) & (size("cy0", "cy1", "line_h") > 0), F.lit(False)))


def words_on_page(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Words with page boxes (gx0..): the line's page corner added."""
    corners = lines.select(*LINE, F.col("gx0").alias("_x"), F.col("gy0").alias("_y"))
    return words.join(corners.hint("merge"), LINE).withColumns(Box.of().shifted(F.col("_x"), F.col("_y")).named("g")).drop("_x", "_y")


def region_words_on_page(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words found in region crops without lines: page boxes, also as x, y, w, h."""
    known = regions.select(*REGION, "px0", "py0", "px1", "py1", "pad_top")
    rows = words.join(known.hint("merge"), REGION)
    g = to_page(Box.of(), Box.of("p"), F.col("pad_top"))
    return rows.withColumns(g.named("g")).withColumns({"gx": F.col("gx0"), "gy": F.col("gy0"), "gw": F.col("gx1") - F.col("gx0"), "gh": F.col("gy1") - F.col("gy0")})


def bubble_order(quads: DataFrame, dist: float = 10.0) -> DataFrame:
    """Detections of a region by (y, x), then one pass that swaps neighbours of a row whose x is out of order.

    The pass carries its result from pair to pair, so it is a fold over the region's sorted boxes.
    """
    item = F.struct(quad_corner("quad", 1).alias("y"), quad_corner("quad", 0).alias("x"), F.col("det_idx"))
    boxes = F.sort_array(F.collect_list(item))
    swap = lambda held, b: (F.abs(b["y"] - held["y"]) < dist) & (b["x"] < held["x"])

    def step(state: Column, b: Column) -> Column:
        held = state["held"]
        swaps = swap(held, b)
        return F.struct(F.concat(state["done"], F.array(F.when(swaps, b).otherwise(held))).alias("done"), F.when(swaps, held).otherwise(b).alias("held"))

    start = F.struct(F.slice("b", 1, 0).alias("done"), F.element_at("b", 1).alias("held"))
    folded = F.aggregate(F.slice("b", F.lit(2), F.size("b")), start, step, lambda s: F.concat(s["done"], F.array(s["held"])))
    rows = quads.groupBy(*REGION).agg(boxes.alias("b")).select(*REGION, F.posexplode(folded).alias("place", "box"))
    return rows.select(*REGION, F.col("box.det_idx").alias("det_idx"), F.col("place").cast("int").alias("place"))


# text -------------------------------------------------------------------------------------------------------------------


def counts_and_offsets(words: DataFrame) -> DataFrame:
    """Words of each line, and how many come before it in its page."""
    lines = words.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n_words"))
    w = Window.partitionBy("image_id").orderBy("region_idx", "line_idx").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum("n_words").over(w), F.lit(0)).cast("long"))


def region_texts(words: DataFrame) -> DataFrame:
    """Each region's word texts in order of line and word, joined by spaces."""
    ordered = F.sort_array(F.collect_list(F.struct("line_idx", "word_idx", F.coalesce("text", F.lit("")).alias("t"))))
    return words.groupBy(*REGION).agg(F.array_join(F.transform(ordered, lambda w: w["t"]), " ").alias("region_text"))


def nested_words(words: DataFrame) -> DataFrame:
    """The nested view: for each region its lines, for each line its page boxes."""
    lines = words.groupBy(*LINE).agg(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", F.array("gx0", "gy0", "gx1", "gy1").alias("box")))), lambda w: w["box"]).alias("boxes"))
    return lines.groupBy(*REGION).agg(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "boxes"))), lambda line: line["boxes"]).alias("lines"))
