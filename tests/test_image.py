"""The pixel stage on small arrays."""

import numpy as np
from pyspark.sql import functions as F

from tagloom.operators import boxes, image


def test_odd_and_grey():
    assert [image.odd(x) for x in (0, 3, 4, 72.9)] == [3, 3, 5, 73]
    assert image.grey(np.array([[[255, 0, 0], [0, 255, 0], [10, 10, 10]]], "uint8")).tolist() == [[76, 150, 10]]
    a = np.zeros((2, 2), "uint8")
    assert image.grey(a) is a


def test_cleaned_keeps_dark_grey_only():
    page = np.full((40, 40, 3), 180, "uint8")
    page[0, 0] = (255, 0, 0)
    page[0, 1] = (250, 250, 250)
    page[0, 2] = (20, 30, 25)
    page[0, 3] = (100, 100, 167)
    page[0, 4] = (100, 100, 168)
    out = image.cleaned(page)
    assert out[0, :3].tolist() == [180, 180, int(image.grey(page)[0, 2])] and out[0, 3] == image.grey(page)[0, 3] and out[0, 4] == 180
    assert image.background(np.arange(16, dtype="uint8").reshape(4, 4)) == 8
    assert image.background(np.array([[7]], "uint8")) == 7


def test_lines_and_components():
    m = np.zeros((6, 30), bool)
    m[1, 2:12], m[1, 14:28], m[3, 5:9] = True, True, True
    assert image.long_runs(m, 10).sum() == 24
    assert image.closed(m, 3)[1, 2:28].all() and not image.closed(m, 2)[1, 12]
    assert image.components(m) == [(2, 1, 12, 2), (14, 1, 28, 2), (5, 3, 9, 4)]
    d = np.eye(5, dtype=bool)
    assert image.components(d) == [(0, 0, 5, 5)]
    u = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert image.components(u) == [(0, 0, 3, 3)]
    assert image.spread(d[:1], 3, 1).tolist() == [[True, True, False, False, False]]
    assert image.outermost([(0, 0, 9, 9), (1, 1, 3, 3), (20, 0, 30, 5)]) == [(0, 0, 9, 9), (20, 0, 30, 5)]


def test_bands_as_over_tables(spark):
    rng = np.random.default_rng(2)
    rows, pages, want = [], [], []
    for k in range(30):
        active = rng.random(400) < rng.choice([0.0, 0.01, 0.03])
        pages.append((k, 400))
        rows += [(k, int(y)) for y in np.flatnonzero(active)]
        want += [(k, i, a, b) for i, (a, b) in enumerate(image.row_bands(active, 40))]
        wide = np.convolve(active.astype(int), np.ones(40, int), mode="same") > 0
        begins, ends = image._runs(wide)
        if len(begins) > 1:
            assert [(max(0, a - 3), 400 if b == 400 else min(400, b + 3)) for a, b in zip(begins, ends, strict=True)] == [(x[2], x[3]) for x in want if x[0] == k]
    got = boxes.bands(spark.createDataFrame(rows, "p long, y int"), spark.createDataFrame(pages, "p long, height int"), ["p"], 40)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def _page(dpi: int = 60) -> np.ndarray:
    page = np.full((600, 500), 230, "uint8")
    for y in range(100, 196, 12):
        page[y : y + 2, 50:400] = 20
    for x in (50, 200, 398):
        page[100:186, x : x + 2] = 20
    page[400:402, 50:400] = 20
    return page


def test_table_boxes_of_a_page(spark):
    found = image.table_candidates(_page(), 60)
    assert found and all(b["n_h"] >= 3 or b["n_v"] >= 3 for b in found)
    b = found[0]
    assert b["depth"] == 0 and b["x1"] < 50 and b["x2"] > 398 and 80 < b["y1"] < 100 and 186 < b["y2"] < 210 and (b["n_h"], b["n_v"]) == (8, 3)
    assert image.table_candidates(np.full((600, 500), 230, "uint8"), 60) == []
    row = lambda k, x: (k, 0, x.shape[0], x.shape[1], 1, bytearray(x.tobytes()))
    pages = spark.createDataFrame([row(1, _page()), row(2, np.full((50, 60), 9, "uint8")), (3, 0, 1, 1, 1, None)], "file_id long, page int, height int, width int, channels int, content binary")
    kept = boxes.table_boxes(image.page_boxes(pages, 60), ["file_id", "page"]).collect()
    assert [r["file_id"] for r in kept] == [1]


def test_words_and_parts_of_a_page(spark):
    xml = "<html><span class='ocrx_word' title='bbox 10 110 40 120'>above</span><span class='ocrx_word' title='bbox 60 210 80 220'>cell</span><span class='ocrx_word' title='bbox 10 400 30 410'>rest</span></html>"
    page = np.full((20, 30), 99, "uint8")
    pages = spark.createDataFrame([(1, 0, 20, 30, 1, bytearray(page.tobytes()))], "file_id long, page int, height int, width int, channels int, content binary")
    words = image.page_words(pages, lambda a: xml if a.shape == (20, 30) else "")
    tables = spark.createDataFrame([(1, 0, 0, 50, 200, 150, 300), (1, 0, 1, 0, 0, 5, 5)], "file_id long, page int, box_id long, x1 int, y1 int, x2 int, y2 int")
    rest, before, inside = image.page_parts(words, tables)
    assert [r["text"] for r in rest.collect()] == ["above rest"] and [(r["box_id"], r["before"]) for r in before.collect()] == [(0, "above")]
    assert [(r["x1"], r["y1"]) for r in inside.collect()] == [(10, 10)]


def test_stamps_and_borders(spark):
    a = np.full((10, 12), 100, "uint8")
    assert image.with_border(a)[2:-2, 2:-2].min() == 100 and image.with_border(a).min() == 0 and image.with_border(a)[1, 5] == 0
    out = image.without_stamp(np.zeros((20, 20), "uint8"), (4, 2, 15, 12))
    assert out[0, 10] == 0 and out[15, 10] == 255 and out[5, 18] == 255 and out[5, 2] == 255 and out[5, 10] == 0
    frames = spark.createDataFrame([(1, 5, 0, 95, 80, 100, 100), (1, 0, 0, 99, 99, 100, 100), (2, 5, 0, 95, 80, 100, 100)], "p long, x1 int, y1 int, x2 int, y2 int, page_w int, page_h int")
    cells = spark.range(15).select(F.lit(1).cast("long").alias("p"), (F.col("id") * 5 + 10).alias("x1"), F.lit(85).alias("y1"))
    assert [tuple(r) for r in image.stamp_frames(frames, cells, ["p"]).collect()] == [(1, 5, 0, 95, 80)]
    assert image.stamp_frames(frames, cells.limit(14), ["p"]).count() == 0
