"""Hand-computed cases and properties of geometry and layout operators."""

import random

from pyspark.sql import functions as F

from pagequarry.functions import geometry
from pagequarry.functions.geometry import Box
from pagequarry.operators import layout


def boxes(spark, rows, **columns):
    df = spark.createDataFrame([("p", i, *map(float, r)) for i, r in enumerate(rows)], "image_id string, region_idx int, x0 double, y0 double, x1 double, y1 double")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def test_a_dropped_region_still_suppresses(spark):
    df = boxes(spark, [(0, 0, 10, 10), (5, 0, 11, 10), (7, 0, 13, 10)])
    assert [r.region_idx for r in layout.suppress_overlaps(df).collect()] == [0]
    assert [r.region_idx for r in layout.suppress_overlaps(df, cell=4.0).collect()] == [0]


def test_suppression_by_cells_equals_suppression(spark):
    r = random.Random(1)
    rows = [(x := r.uniform(0, 90), y := r.uniform(0, 90), x + r.uniform(1, 30), y + r.uniform(1, 30)) for _ in range(120)]
    df = boxes(spark, rows)
    a, b = (sorted(x.region_idx for x in layout.suppress_overlaps(df, cell=c).collect()) for c in (None, 16.0))
    assert a == b and a[0] == 0


def test_empty_and_inverted_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 5.0, 4.0, 4.0, 0.0, 0.0)], "l_x0 double, l_y0 double, l_x1 double, l_y1 double, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    row = df.select(geometry.overlap_ratio(Box.of("r_"), Box.of("l_")).alias("none"), Box.of("r_").area().alias("area")).first()
    assert row["none"] is None and row["area"] == 16.0


def test_padding_and_line_box(spark):
    df = spark.createDataFrame([(100,), (5,)], "h int").select(geometry.padded_height(F.col("h")), geometry.top_padding(F.col("h")))
    assert [tuple(r) for r in df.collect()] == [(120, 10), (6, 0)]
    q = spark.createDataFrame([([12.4, 5.6, 50.2, 6.1, 50.8, 20.3, 11.9, 19.7],)], "quad array<double>")
    local = geometry.line_box("quad")
    page = geometry.to_page(local, Box(F.lit(100), F.lit(200), F.lit(0), F.lit(0)), F.lit(10))
    assert tuple(q.select(*local.named().values()).first()) == (11, 6, 51, 20)
    assert tuple(q.select(*page.named().values()).first()) == (111, 196, 151, 210)


def lines(spark, rows, h, w):
    return spark.createDataFrame([("p", 0, i, *r, h, w) for i, r in enumerate(rows)], "image_id string, region_idx int, line_idx int, x0 int, y0 int, x1 int, y1 int, crop_h int, crop_w int")


def test_line_dilation(spark):
    df = layout.dilate_lines_horizontally(layout.dilate_lines_vertically(lines(spark, [(10, 10, 60, 30), (12, 38, 58, 50)], 100, 70)))
    got = [(r.x0, r.y0, r.x1, r.y1, r.dil_top, r.dil_bottom, r.dil_left, r.dil_right) for r in df.orderBy("line_idx").collect()]
    assert got == [(3, 8, 67, 34, 2, 4, 7, 7), (7, 34, 63, 51, 4, 1, 5, 5)]
    one = layout.dilate_lines_vertically(lines(spark, [(0, 1, 9, 31)], 40, 50)).first()
    assert (one.y0, one.y1, one.dil_top, one.dil_bottom) == (0, 31, 1, 0)


def dilated_in_turn(rows, h, rate=0.1):
    """Lines one after the other, each step seeing what earlier ones changed."""
    out, dil = [list(r) for r in rows], [[0, 0] for _ in rows]
    for i, (_, top, _, bottom) in enumerate(rows):
        if i == 0:
            t = int((bottom - top) * rate)
            dil[0][0] = t if top - t > 0 else top
            out[0][1] = max(top - t, 0)
        if 0 < i == len(rows) - 1:
            b = int((bottom - out[i][1]) * rate)
            dil[i][1] = b if bottom + b < h else h - bottom
            out[i][3] = bottom + dil[i][1]
        if i + 1 < len(rows) and (gap := rows[i + 1][1] - bottom) > 0:
            out[i][3], dil[i][1] = bottom + gap // 2, gap // 2
            out[i + 1][1], dil[i + 1][0] = rows[i + 1][1] - gap // 2, gap // 2
    return [(*o, *d) for o, d in zip(out, dil, strict=True)]


def test_line_dilation_equals_a_sequential_pass(spark):
    r = random.Random(2)
    for _ in range(12):
        rows, y = [], 0
        for _ in range(r.randint(1, 6)):
            y += r.randint(0, 12)
            rows.append((0, y, 50, y := y + r.randint(4, 40)))
        h = y + r.randint(0, 4)
        got = layout.dilate_lines_vertically(lines(spark, rows, h, 70)).orderBy("line_idx").select("x0", "y0", "x1", "y1", "dil_top", "dil_bottom")
        assert [tuple(x) for x in got.collect()] == dilated_in_turn(rows, h)


def test_word_dilation(spark):
    df = spark.createDataFrame([("p", 0, 0, 0, 0.0, 10.0, 20.0, 20.0, 30, 100), ("p", 0, 0, 1, 26.0, 9.0, 50.0, 21.0, 30, 100)], "image_id string, region_idx int, line_idx int, word_idx int, x0 double, y0 double, x1 double, y1 double, line_h int, line_w int")
    got = layout.dilate_words(df).orderBy("word_idx").collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got] == [(0, 0, 23, 30), (23, 9, 50, 21)]
    assert [(r.cx0, r.cy0, r.cx1, r.cy1, r.crop_ok) for r in got] == [(0, 10, 23, 20, True), (23, 9, 50, 21, True)]
    flat = layout.dilate_words(df, vertical=False).orderBy("word_idx").collect()
    assert [r.crop_ok for r in flat] == [False, True] and flat[0].y0 == 10


def test_recogniser_geometry(spark):
    df = spark.createDataFrame([(20, 60), (10, 100), (32, 256)], "h int, w int").withColumns(geometry.recogniser_geometry(F.col("h"), F.col("w")))
    got = [(r.resized_w, r.resized_h, r.pad_right, r.pad_bottom, r["mask"]) for r in df.collect()]
    assert got == [(96, 32, 160, 0, 96), (256, 25, 0, 7, 256), (256, 32, 0, 0, 0)]


def test_bubble_order_equals_a_pass_of_swaps(spark):
    r = random.Random(3)
    quads = [[r.randint(0, 60), r.randint(0, 40)] for _ in range(9)]
    df = spark.createDataFrame([("p", 0, i, [float(x), float(y)] + [0.0] * 6) for i, (x, y) in enumerate(quads)], "image_id string, region_idx int, det_idx int, quad array<double>")
    held = sorted(range(9), key=lambda i: (quads[i][1], quads[i][0], i))
    for i in range(8):
        a, b = held[i], held[i + 1]
        if abs(quads[b][1] - quads[a][1]) < 10 and quads[b][0] < quads[a][0]:
            held[i], held[i + 1] = b, a
    assert [x.det_idx for x in layout.bubble_order(df).orderBy("place").collect()] == held


def test_region_text_and_single_line(spark):
    words = spark.createDataFrame([("p", 0, 1, 0, "c"), ("p", 0, 0, 1, None), ("p", 0, 0, 0, "a"), ("p", 1, 0, 0, "z")], "image_id string, region_idx int, line_idx int, word_idx int, text string")
    assert {r.region_idx: r.region_text for r in layout.region_texts(words).collect()} == {0: "a  c", 1: "z"}
    regions = spark.createDataFrame([("p", 0, 10.0), ("p", 1, 10.0), ("p", 2, 10.0)], "image_id string, region_idx int, elem_height double")
    got = layout.single_lines(regions, words.select("image_id", "region_idx", "line_idx").distinct()).orderBy("region_idx").collect()
    assert [(r.single_line, r.elem_height) for r in got] == [(False, 10.0), (True, 15.0), (False, 10.0)]
