"""Images to pages with the stand-in models; files, sinks and streams."""

import json
import os
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagequarry import schemas
from pagequarry.functions.text import VOCABULARY
from pagequarry.operators import inference, pixels
from pagequarry.plans import catalog, evaluation, ocr, synthetic
from pagequarry.sources import files, sinks
from pagequarry.streaming import pages as streams


def page():
    image = np.full((80, 120, 3), 255, dtype=np.uint8)
    image[10:18, 10:30] = 0
    image[10:18, 40:60] = 60
    image[24:32, 10:50] = 20
    return image


def images(spark, *pictures):
    return spark.createDataFrame([(f"p{i}", *p.shape[:2], 3, 16, bytearray(p.tobytes())) for i, p in enumerate(pictures)], schemas.IMAGES)


def test_pages_are_read(spark):
    read = ocr.read_pages(images(spark, page(), np.full((40, 40, 3), 255, dtype=np.uint8)))
    words = read.words.orderBy("image_id", "region_idx", "line_idx", "word_idx").collect()
    assert [(w.image_id, w.line_idx, w.word_idx) for w in words] == [("p0", 0, 0), ("p0", 0, 1), ("p0", 1, 0)]
    assert all(8 <= len(w.text) <= 24 and w.crop_ok for w in words)
    region = read.regions.first()
    assert region.text == " ".join(w.text for w in words) and not region.single_line
    html = read.html().first().html
    assert 'class="paragraph"' in html
    flat = ocr.read_regions(images(spark, page())).orderBy("word_idx").collect()
    assert len(flat) == 1 and (flat[0].gx, flat[0].gw) == (10, 50)  # without lines, columns of both lines are one word


@pytest.mark.parametrize("name", ["recognize_stub", "read_pages_html", "recognize_without_lines"])
def test_pixels_and_boxes_are_not_broadcast(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pages_are_drawn_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(synthetic, "table", lambda spark, *_: spark.range(1, 1001, numPartitions=1).withColumnRenamed("id", "s_suppkey"))
    drawn = []

    def keep(self, f, schema):
        drawn.extend(len(x) for x in f(iter([pd.DataFrame({"s_suppkey": range(1000)})])))
        return self.select(F.lit(0).alias("image_id"))

    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", keep)
    synthetic.stub_images(spark, "")
    assert sum(drawn) == 1000 and max(drawn) <= synthetic.PAGES


def test_pixels():
    fitted, mask = pixels.fit(np.zeros((20, 60, 3), dtype=np.uint8))
    assert fitted.shape == (32, 256, 3) and mask == 96 and (fitted[:, 96:] == 255).all() and (fitted[:, :96] == 0).all()
    padded, top = pixels.pad_rows(np.zeros((100, 3, 3), dtype=np.uint8))
    assert (len(padded), top) == (120, 10)
    ramp = np.repeat(np.arange(40, dtype=np.uint8)[None, :, None], 30, axis=0).repeat(3, axis=2)
    cut = pixels.rotated_crop(ramp, np.array([[5, 5], [25, 5], [25, 15], [5, 15]]))
    assert cut.shape == (10, 20, 3) and (cut == ramp[5:15, 5:25]).all()
    assert pixels.rotated_crop(ramp, np.array([[5, 5], [10, 5], [10, 25], [5, 25]])).shape == (5, 20, 3)
    batch = pixels.batch([np.zeros((8, 8, 3), dtype=np.uint8)] * 3)
    assert batch["image"].shape == (3, 32, 256, 3) and batch["pos"].shape == (3, 40)


def test_recognise_handles_crops_without_area(spark):
    crops = spark.createDataFrame([("p", 0, 0, 0, 0, 0, bytearray())], schemas.CROPS)
    assert inference.recognise(crops, inference.MeanRecogniser).first().text == ""
    assert inference.decode_tokens(np.array([[0, 37, 95, 38]])) == [VOCABULARY[37]]


def png(path, image):
    rows = b"".join(b"\0" + r[:, ::-1].tobytes() for r in image)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as out:
        out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_files(spark, tmp_path):
    folder = tmp_path / "img"
    folder.mkdir()
    png(folder / "p1.png", page())
    (folder / "notes.csv").write_text("x")
    row = files.images(spark, str(folder)).first()
    assert (row.image_id, row.ext, row.height, row.width) == ("p1", "png", 80, 120) and bytes(row.data) == page().tobytes()
    listed = files.image_files(spark, str(folder))
    size = listed.first().n_bytes
    assert [r.file_name for r in listed.collect()] == ["p1.png"] and size == os.path.getsize(folder / "p1.png")
    via = {f"p1.png{size}": {"regions": [{"shape_attributes": {"name": "polygon"}, "region_attributes": {"name": "x"}}, {"shape_attributes": {"name": "rect", "x": 10, "y": 20, "width": 30, "height": 12}, "region_attributes": {"name": "w"}}]}}
    words = files.via_words(listed, spark.createDataFrame([(json.dumps(via),)], "json string")).collect()
    assert [tuple(w) for w in words] == [("p1.png", 0, 10.0, 20.0, 40.0, 32.0, "w")]
    coco = {"images": [{"id": 7, "file_name": "p1.png"}, {"id": 8, "file_name": "p1.png"}], "annotations": [{"id": 1, "image_id": 7, "category_id": 2, "bbox": [0, 0, 1, 1]}, {"id": 2, "image_id": 7, "category_id": 1, "bbox": [1, 2, 3, 4]}, {"id": 3, "image_id": 8, "category_id": 1, "bbox": [1, 2, 3, 4]}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    regions = files.coco_regions(*files.coco(spark, str(tmp_path / "c.json")))
    texts = spark.createDataFrame([("p1.png", 2, "t")], schemas.GT_TEXT_FILE)
    good, bad = files.with_region_texts(regions, texts)
    assert [(r.gt_idx, r.ann_id, r.x1, r.y1, r.text) for r in good.collect()] == [(0, 2, 4.0, 6.0, "t")] and bad.count() == 0


def test_sinks_and_evaluation(spark, tmp_path):
    box = "x0 double, y0 double, x1 double, y1 double"
    truth = evaluation.Truth(spark.createDataFrame([("a", 0, 0.0, 0.0, 50.0, 20.0, "। ?")], f"image_id string, gt_idx int, {box}, text string"), spark.createDataFrame([("a", 0, 0.0, 0.0, 10.0, 10.0, "।"), ("a", 1, 20.0, 0.0, 30.0, 10.0, "?")], f"image_id string, word_pos int, {box}, text string"))
    predicted = evaluation.Predicted(spark.createDataFrame([("a", 0, 0.0, 0.0, 50.0, 20.0, "। !")], f"image_id string, pred_idx int, {box}, region_text string"), spark.createDataFrame([("a", 0, 0, 0, 0.0, 0.0, 10.0, 10.0, "।"), ("a", 0, 0, 1, 21.0, 0.0, 31.0, 10.0, "!")], f"image_id string, pred_idx int, line_idx int, word_idx int, {box}, text string"))
    row = evaluation.metrics_v1(truth, predicted).first()
    assert (row.average_NED, row.average_accuracy, row.average_precision, row.average_f1) == (0.5, 0.5, 0.5, 0.5)
    two = evaluation.metrics_v2(truth, predicted)
    assert tuple(two.first()) == ("a", 1 / 3, 0.5)
    sinks.metrics_v2(two, str(tmp_path / "v2"))
    sinks.metrics_v1(evaluation.metrics_v1(truth, predicted), str(tmp_path / "v1"))
    sinks.word_scores(evaluation.scores(evaluation.align(truth, predicted)), str(tmp_path / "scores"))
    assert spark.read.csv(str(tmp_path / "scores"), header=True).count() == 2
    for _ in range(2):
        sinks.predictions({"words": predicted.words}, str(tmp_path / "run"), "r1")
    assert files.predictions(spark, str(tmp_path / "run"), "r1", "words").count() == 2
    sinks.pages(spark.createDataFrame([("a", "<p>\n</p>")], "image_id string, html string"), str(tmp_path / "html"))
    assert spark.read.text(str(tmp_path / "html")).count() == 2
    timings = spark.createDataFrame([("a", "line", 1.0), ("a", "word", 2.0)], schemas.RUNTIMES)
    sinks.runtimes(evaluation.corpus_timings(timings), str(tmp_path / "rt"))
    assert spark.read.csv(str(tmp_path / "rt"), header=True).first()["full_pipeline"] == "3.0"


def test_streams(spark, tmp_path):
    words = spark.createDataFrame([("p", 0, 0, 0, None, 0.0, 0.0, 1.0, 1.0, "a"), ("p", 0, 0, 1, None, 0.0, 0.0, 1.0, 1.0, "b")], schemas.WORDS)
    words.coalesce(1).write.parquet(str(tmp_path / "in"))
    streams.write_texts(streams.word_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("region_text").first()[0] == "a b"
    batch = spark.sql("SELECT 'line' AS stage, timestamp'2024-01-01 10:20:00' AS ts, 2.0D AS seconds")
    row = streams.stage_windows(batch).first()
    assert (row.n, row.seconds, str(row.window_start)) == (1, 2.0, "2024-01-01 10:00:00")


def test_stage_timer(spark):
    from pagequarry.plans.timing import StageTimer

    timer = StageTimer("r")
    for name in ("line", "word"):
        with timer.stage(name):
            spark.range(10).count()
    total = evaluation.corpus_timings(timer.frame(spark)).first()
    assert total.image_id == "r" and abs(total.full_pipeline - sum(r[2] for r in timer.rows)) < 1e-9


def test_pages_hold_the_words_regions_of_the_views(spark, tmp_path):
    """Pages cut at any size, null and repeated ids, odd white space: the rows of the SQL; queries of matches move texts only, in one pass."""
    from pagequarry.plans import catalog, synthetic as S
    from tests.oracle import connect, spark_rows, sql_rows

    text = "one  two\n\n three e e e e e four\r five six ab\U0001f600c\n" * 9
    docs = [(k, t) for k, t in enumerate([text, None, "", " \n ", "x", "é" * 40, "a\n" * 60, text[::-1]])] + [(None, "lost words"), (40, "same words same words"), (40, "same words same words")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    pieces = [(i, t) for i, t in docs if i is not None and i < 40]
    spark.createDataFrame(pieces, "doc_id long, text string").write.parquet(f"{tmp_path}/once/documents.parquet")
    spark.createDataFrame([(1,)], "s_suppkey long").write.parquet(f"{tmp_path}/once/supplier.parquet")
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/once/{t}.parquet/*.parquet'")
    for name in ("greedy_pred_pivot", "greedy_gt_pivot", "word_scores", "metrics_v1", "metrics_v1_summary"):
        assert spark_rows(catalog.QUERIES[name](spark, f"{tmp_path}/once")) == sql_rows(con, catalog.ORACLE_SQL[name]), name
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "CoGroup" not in plan
    rows = catalog.QUERIES["metrics_v1"](spark, str(tmp_path)).collect()
    assert len(rows) == 11  # eight texts, one id twice, none, one supplier
    whole = list(S.pages(iter([pa_batch(docs)])))
    assert sum(len(p.gt_words.image) for p in whole) == len(S.words(spark, str(tmp_path)).where("image_id IS NOT NULL").collect())


def pa_batch(docs):
    import pyarrow as pa

    docs = sorted(((str(i), t or "") for i, t in docs if i is not None))
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["image_id", "t"])
