"""Schemas (DDL) of the keyed tables. Position in nested lists is replaced by explicit keys (image_id, region_idx, line_idx, word_idx)."""

from __future__ import annotations

#: Classes of the layout model by id.
CLASSES = {0: "paragraph", 1: "text_box", 2: "image", 3: "table"}
TEXT_CLASSES = ("paragraph", "text_box")


REGIONS = (
    "image_id STRING, region_idx INT, class_id INT, class STRING, nx0 DOUBLE, ny0 DOUBLE, nx1 DOUBLE, ny1 DOUBLE, left DOUBLE, top DOUBLE,"
    " elem_height DOUBLE, elem_width DOUBLE, img_height INT, img_width INT, text STRING, single_line BOOLEAN, img_src STRING"
)
LINES = ("image_id STRING, region_idx INT, line_idx INT, x0 INT, y0 INT, x1 INT, y1 INT, dil_top INT, dil_bottom INT, dil_left INT, dil_right INT")
WORDS = ("image_id STRING, region_idx INT, line_idx INT, word_idx INT, quad ARRAY<DOUBLE>, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, text STRING")
GT_REGIONS = ("image_id STRING, gt_region_idx INT, ann_id BIGINT, category_id INT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, text STRING")
GT_WORDS = ("image_id STRING, gt_word_pos INT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, text STRING")
WORD_SCORES = ("image_id STRING, dla_box_idx INT, gt_word_idx INT, gt_word STRING, pred_word_idx INT, pred_word STRING, cer DOUBLE, lev INT")
METRICS_V1 = ("file_stem STRING, average_NED DOUBLE, average_accuracy DOUBLE, average_precision DOUBLE, average_f1 DOUBLE")
METRICS_V2 = ("file_stem STRING, doc_cer DOUBLE, doc_wer DOUBLE")
RUNTIMES = ("image_id STRING, stage STRING, seconds DOUBLE")

#: An image table as Spark's image source gives it, with its key.
IMAGES = ("image_id STRING, height INT, width INT, n_channels INT, mode INT, data BINARY")
DETECTIONS = ("image_id STRING, region_idx INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, class_id INT, img_height INT, img_width INT")
QUADS = ("image_id STRING, region_idx INT, det_idx INT, quad ARRAY<DOUBLE>")
CROPS = ("image_id STRING, region_idx INT, line_idx INT, word_idx INT, height INT, width INT, data BINARY")

#: Annotation files.
VIA_FILE = (
    "regions ARRAY<STRUCT<shape_attributes: STRUCT<name: STRING, x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>, region_attributes: STRUCT<name: STRING>>>"
)
COCO_FILE = ("images ARRAY<STRUCT<id: BIGINT, file_name: STRING>>, annotations ARRAY<STRUCT<id: BIGINT, image_id: BIGINT, category_id: INT, bbox: ARRAY<DOUBLE>>>")
GT_TEXT_FILE = ("file_name STRING, id BIGINT, text STRING")
