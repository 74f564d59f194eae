"""Text functions, matching and metrics against hand-computed and brute-force results."""

import random

from pyspark.sql import functions as F

from pagequarry.functions import html, text
from pagequarry.operators import matching, metrics


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_vocabulary():
    assert len(text.VOCABULARY) == 97 and text.SEPARATOR == 95 and text.VOCABULARY[94] == "‍"
    assert text.VOCABULARY[81:84] == ["ড়", "ঢ়", "য়"]


def test_token_decode(spark):
    decode = lambda ids: one(spark, text.decoded(F.array(*[F.lit(i) for i in ids])))
    assert decode([0, 37, 95, 38]) == "ক"
    assert decode([95, 37, 38]) == "কখ"
    assert decode([5]) == ""
    assert decode([0, 0, 96]) == "blankpad"


def test_gt_word(spark):
    rows = spark.createDataFrame([("কলম",), ("ক2",), (" কলম\n",), ("য়",), ("য়",)], "t string")
    got = [r[0] for r in rows.select(text.gt_word(F.col("t"))).collect()]
    assert got == ["কলম", None, "কলম", "য়", "য়"]


def test_ned(spark):
    rows = spark.createDataFrame([("কলম", "কলা"), ("", ""), ("", "ab"), ("ab", "")], "g string, p string")
    got = [tuple(r) for r in rows.select(text.word_ned(F.col("g"), F.col("p")), text.word_distance(F.col("g"), F.col("p"))).collect()]
    assert got == [(1 / 3, 1), (1.0, 0), (1.0, 2), (1.0, 2)]


def test_wer_equals_textbook_distance(spark):
    r = random.Random(4)
    pairs = [("the cat sat", "the cat sat on mat"), ("", "x"), ("a\nb", "a b")] + [(" ".join(r.choices("abcde", k=r.randint(1, 12))), " ".join(r.choices("abcde", k=r.randint(0, 12)))) for _ in range(40)]
    df = spark.createDataFrame(pairs, "r string, h string").select("r", "h", text.document_wer(F.col("r"), F.col("h")).alias("fast"), text.slow_wer("r", "h").alias("slow"))
    for row in df.collect():
        expected = text.word_edits(row.r, row.h) / len(row.r.split()) if row.r.split() else None
        assert row.fast == row.slow == expected
    assert text.word_edits("the cat sat", "the cat sat on mat") == 2


def test_edits_equal_the_table_and_take_long_texts(spark):
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, u in enumerate(a, 1):
            diagonal, row[0] = row[0], i
            for j, v in enumerate(b, 1):
                diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (u != v))
        return row[-1]

    r = random.Random(8)
    for _ in range(400):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 90))) for _ in range(2))
        assert text.edits(a, b) == table(a, b) and text.edits(list(a), list(b)) == table(a, b)
    # more distinct words than one string of codes held, and texts for which a table of cells takes minutes
    long = [str(k) for k in range(25_000)]
    df = spark.createDataFrame([(" ".join(long), " ".join(["x", *long[:-2]])), (None, "a"), ("", "a")], "r string, h string")
    rows = df.select(text.document_wer(F.col("r"), F.col("h")).alias("w"), text.document_cer(F.col("r"), F.col("h")).alias("c")).collect()
    assert rows[0].w == 3 / 25_000 and rows[0].c is not None and [tuple(x) for x in rows[1:]] == [(None, None)] * 2


def test_permutation(spark):
    assert text.permutation(5) == [0, 1, 3, 2, 4]
    assert spark.range(1).select(text.permutation_of(F.lit(5)).alias("p")).first()["p"] == [0, 1, 3, 2, 4]


def test_best_region_and_superboxes(spark):
    pred = spark.createDataFrame([("p", 0, 0.0, 20.0, 10.0, 30.0), ("p", 1, 0.0, 0.0, 10.0, 10.0), ("p", 2, 0.0, 24.0, 10.0, 29.0), ("p", 3, 90.0, 90.0, 99.0, 99.0)], "image_id string, pred_idx int, x0 double, y0 double, x1 double, y1 double")
    gt = spark.createDataFrame([("p", 0, 0.0, 0.0, 10.0, 12.0), ("p", 1, 50.0, 0.0, 60.0, 12.0), ("p", 2, 0.0, 19.0, 10.0, 31.0), ("p", 3, 0.0, 19.0, 10.0, 31.0)], "image_id string, gt_idx int, x0 double, y0 double, x1 double, y1 double")
    m = matching.best_regions(pred, gt)
    assert {r.pred_idx: r.gt_idx for r in m.collect()} == {0: 2, 1: 0, 2: 2, 3: -1}
    got = matching.superboxes(m, gt).orderBy("place").collect()
    assert [(r.gt_idx, r.preds) for r in got] == [(2, [0, 2]), (0, [1]), (1, []), (3, [])]


def greedy(candidates, n):
    taken, out = set(), {}
    for p in range(n):
        best = max(((iou, -g) for q, g, iou in candidates if q == p and g not in taken), default=None)
        if best:
            out[p] = -best[1]
            taken.add(out[p])
    return out


def test_greedy_matches_equal_the_loop(spark):
    cases = [[(0, 1, 0.9), (1, 1, 0.8), (1, 0, 0.6)]]
    r = random.Random(5)
    cases += [[(p, g, round(r.uniform(0.5, 0.9), 1)) for p in range(8) for g in range(8) if r.random() < 0.5] for _ in range(25)]
    rows = [(k, *c) for k, case in enumerate(cases) for c in case]
    df = spark.createDataFrame(rows, "k int, p int, g int, iou double")
    found = {k: {} for k in range(len(cases))}
    for row in matching.greedy_matches(df, "p", "g", ["k"]).collect():
        found[row.k][row.p] = row.g
    assert found[0] == {0: 1, 1: 0}
    assert all(found[k] == greedy(case, 8) for k, case in enumerate(cases))


def test_word_matches_equal_candidates_and_greedy_choice(spark):
    r = random.Random(6)

    def words(n, idx):
        rows = []
        for k in range(n):
            x, y = r.randint(-80, 120), r.choice([-10, 0, 60, 130])
            box = [float(x), float(y), float(x + r.choice([20, 30, 90])), float(y + r.choice([10, 12]))]
            rows.append((r.choice("ab"), r.choice([0, 1]), k, *(box[2:] + box[:2] if k % 9 == 8 else box), f"{idx}{k}"))
        return spark.createDataFrame(rows + [("a", 0, n, None, 0.0, 1.0, 1.0, "null"), (f"only {idx}", 0, 0, 0.0, 0.0, 9.0, 9.0, "x")], f"image_id string, gt_idx int, {idx} int, x0 double, y0 double, x1 double, y1 double, text string")

    pred, gt = words(150, "pred_word_idx"), words(120, "gt_word_idx")
    found = matching.word_matches(pred, gt, texts=True).collect()
    assert len(found) == 122
    keys = ["image_id", "gt_idx"]
    candidates = matching.match_candidates(pred, gt)
    by_gt = {(m.image_id, m.gt_idx, m.gt_word_idx): (m.pred_word_idx, m.iou) for m in matching.greedy_matches(candidates, "gt_word_idx", "pred_word_idx", keys).collect()}
    by_pred = {(m.image_id, m.gt_idx, m.gt_word_idx): (m.pred_word_idx, m.iou) for m in matching.greedy_matches(candidates, "pred_word_idx", "gt_word_idx", keys).collect()}
    assert len(by_gt) > 20 and by_gt != by_pred
    assert {(m.image_id, m.gt_idx, m.gt_word_idx): (m.pred_word_idx, m.iou) for m in found if m.iou is not None} == by_gt
    assert {(m.image_id, m.gt_idx, m.gt_word_idx): (m.by_pred, m.by_pred_iou) for m in found if m.by_pred_iou is not None} == by_pred
    assert all(m.pred_text == (None if m.iou is None else f"pred_word_idx{m.pred_word_idx}") for m in found)


def test_metrics_v1(spark):
    scores = spark.createDataFrame([("a", 0.0, True), ("a", 0.0, True), ("a", 1.0, False), ("a", 1.0, False)], "image_id string, cer double, correct boolean")
    matched = spark.createDataFrame([("a", 3)], "image_id string, matched long")
    images = spark.createDataFrame([("a",), ("b",)], "image_id string")
    got = {r.file_stem: tuple(round(v, 4) for v in r[1:]) for r in metrics.metrics_v1(scores, matched, images).collect()}
    assert got == {"a": (0.5, 0.5, 0.6667, 0.5714), "b": (0.0, 1.0, 1.0, 1.0)}


def test_metrics_v2_joins_regions_in_seeded_order(spark):
    order = spark.createDataFrame([("p", 0, 0, 1, 0), ("p", 0, 0, 0, 1)], "image_id string, gt_idx int, place int, pred_idx int, member int")
    superbox = spark.createDataFrame([("p", 0, 0), ("p", 1, 1), ("p", 2, 2)], "image_id string, gt_idx int, place int")
    gt = spark.createDataFrame([("p", 0, "b a"), ("p", 1, "c"), ("p", 2, "")], "image_id string, gt_idx int, text string")
    pred = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b")], "image_id string, pred_idx int, region_text string")
    row = metrics.document_texts(order, superbox, gt, pred).first()
    refs, hyps = ["b a", "c"], ["b a", ""]
    p = text.permutation(2)
    assert row.reference == "\n".join(refs[i] for i in p) and row.hypothesis == "\n".join(hyps[i] for i in p)
    images = spark.createDataFrame([("p",), ("q",)], "image_id string")
    got = {r.file_stem: (r.doc_cer, r.doc_wer) for r in metrics.metrics_v2(metrics.document_texts(order, superbox, gt, pred), images).collect()}
    assert got == {"p": (1 / 5, 1 / 3), "q": (None, None)}


def test_summary_and_f1(spark):
    df = spark.createDataFrame([("a", 0.2, 0.5, 1.0), ("b", 0.4, 1.0, 0.5), ("c", 0.9, 0.0, 0.0)], "file_stem string, average_NED double, average_accuracy double, average_precision double")
    row = metrics.summary_v1(df).first()
    assert abs(row["mean_average_NED"] - 0.5) < 1e-12 and abs(row["std_average_NED"] - 0.13**0.5) < 1e-12
    got = [r[0] for r in df.select(text.f1(F.col("average_precision"), F.col("average_accuracy"))).collect()]
    assert [round(x, 6) for x in got] == [0.666667, 0.666667, 0.0]


def test_html(spark):
    rows = spark.createDataFrame([("p", 1, "image", "", "./img/p_1.png"), ("p", 0, "paragraph", "a<b & c", None), ("p", 2, "table", "x", None)], "image_id string, region_idx int, class string, text string, img_src string")
    page = html.documents(rows.withColumns({c: F.lit(1) for c in ("top", "left", "elem_height", "elem_width")})).first().html
    assert page.index("a&lt;b &amp; c") < page.index("./img/p_1.png") and ">x<" not in page


def test_page_matches_equal_the_table_operators(spark):
    """Odd boxes, words of several regions, crowded places and images that only one side has."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(9)
    images = ["a", "b", "c", "only truth", "only found"]

    def boxes(n, *index, images=images[:3], text=False):
        rows = {}
        while len(rows) < n:
            x, y, w, h = r.randrange(-90, 90, 3), r.choice([-10, 0, 7, 60]), *((r.choice([30, 40]), r.choice([0, 10, 12])) if text else (r.choice([90, 200]), r.choice([20, 80])))
            box = (x, y, x + w, y + h) if r.random() < 0.9 else (x + w, y + h, x, y)
            box = tuple(float(v) for v in box) if r.random() < 0.97 else (None, 0.0, 1.0, 1.0)
            rows.setdefault((r.choice(images), *(r.randrange(i) for i in index)), box)
        return [(*k, *b, *([r.choice(["!%", "!&", "", "ab", "ক", "ক‍", " #", "ড়"])] if text else [])) for k, b in rows.items()]

    table = {"gt_regions": boxes(30, 40, images=images[:4]), "gt_words": boxes(420, 900, images=images[:4], text=True)}
    table |= {"pred_regions": boxes(40, 40, images=[*images[:3], "only found"]), "pred_words": boxes(900, 40, 5, 20, text=True)}
    index = {"gt_regions": ["gt_idx"], "gt_words": ["word_pos"], "pred_regions": ["pred_idx"], "pred_words": ["pred_idx", "line_idx", "word_idx"]}
    corners = ["x0", "y0", "x1", "y1"]

    def frame(name):
        columns = ["image_id string", *(f"{c} int" for c in index[name]), *(f"{c} double" for c in corners), *(["text string"] if "words" in name else [])]
        return spark.createDataFrame(table[name], ", ".join(columns))

    def arrays(name):
        rows, n = table[name], len(index[name])
        numbers = np.array([row[1 : 1 + n] for row in rows])
        box = np.array([row[1 + n : 5 + n] for row in rows], dtype=float)
        return matching.Boxes(np.array([images.index(row[0]) for row in rows]), numbers if n > 1 else numbers[:, 0], box, pa.array([row[-1] for row in rows]) if "words" in name else None)

    t = {name: frame(name) for name in table}
    superbox = matching.superboxes(matching.best_regions(t["pred_regions"], t["gt_regions"]), t["gt_regions"])
    pred, gt = matching.merged_words(t["pred_words"], superbox), matching.words_in_regions(t["gt_words"], t["gt_regions"])
    expected = matching.word_matches(pred, gt, texts=True)
    rows = {(x.image_id, x.gt_idx, x.gt_word_idx): (x.pred_word_idx, x.iou, x.by_pred, x.by_pred_iou) for x in expected.collect()}
    pages = matching.Pages(pa.array(images), *(arrays(name) for name in table))
    m = matching.page_matches(pages)
    number = lambda at: None if at < 0 else int(m.pred_word_idx[at])
    found = {
        (images[i], int(g), int(k)): (number(a), x if a >= 0 else None, number(b), y if b >= 0 else None)
        for i, g, k, a, x, b, y in zip(m.image, m.gt_idx, m.gt_word_idx, m.by_gt, m.by_gt_iou, m.by_pred, m.by_pred_iou, strict=True)
    }
    assert found == rows and sum(x[0] is not None for x in rows.values()) > 10 and any(x[0] != x[2] for x in rows.values())
    scores = {(x.image_id, x.dla_box_idx, x.gt_word_idx): (x.gt_word, x.pred_word, x.cer, x.lev, x.correct) for x in metrics.scored_words(expected).collect()}
    columns = metrics.page_scores(pages, m)
    mine = zip(m.image, m.gt_idx, m.gt_word_idx, columns["gt_word"].to_pylist(), columns["pred_word"].to_pylist(), columns["cer"], columns["lev"], columns["correct"], strict=True)
    assert {(images[i], int(g), int(k)): tuple(x) for i, g, k, *x in mine if x[0] is not None} == scores
    sums = {x.image_id: tuple(x[1:]) for x in metrics.image_sums(expected).collect()}
    for row in metrics.page_sums(pages, m).to_pylist():
        n, cer, correct, matched = sums.get(row["image_id"], (None, None, 0, None))
        assert (row["n"], row["correct"], row["matched"]) == (n, correct, matched) and abs((row["cer"] or 0) - (cer or 0)) < 1e-9


def test_greedy_rows_equal_the_loop():
    import numpy as np

    r = random.Random(11)
    for _ in range(300):
        rows = list({(r.randrange(6), r.randrange(6)): r.choice([0.6, 0.7, 0.8]) for _ in range(r.randint(0, 14))}.items())
        pivot, other, ratio = (np.array(x) for x in ([p for (p, _), _ in rows], [o for (_, o), _ in rows], [x for _, x in rows]))
        kept = {rows[i][0] for i in matching.greedy_rows(pivot, other, ratio)}
        assert kept == set(greedy([(p, o, x) for (p, o), x in rows], 6).items())
