"""The pixel stage of scanned pages: cleaning, lines, bands and table boxes, run page by page in mapInPandas.

Recognition itself is an engine that the caller gives; all else is numpy on one page's array, so a page costs its own
memory and nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import boxes
from tagloom.operators.boxes import DPI, PAD, SHRINK
from tagloom.sources.files import recognised_words

# --- fixed values ---------------------------------------------------------------------------------
COLOUR_SPREAD, LIGHT = int(1.5 * 45), 200
GREY_WEIGHTS, GREY_BITS = (4899, 9617, 1868), 14  # red, green and blue in 2 ** 14 parts
LINE, LINE_BLOCK, LINE_OFFSET = 1.2, 0.25, 8  # least length of a line and width of the neighbourhood in inches, and by how much it is darker
LEAST_WIDTH, LEAST_HEIGHT, LEAST_LINES, SPAN, GAP, EDGE = 2.0, 0.6, 3, 0.75, 0.15, 0.05
SPREAD, MOST_DEPTH = 0.15, 5
STAMP_FRAME, STAMP_ASPECT, STAMP_CELLS = 0.5, (0.5, 2.0), 15
# --------------------------------------------------------------------------------------------------


def odd(n: float) -> int:
    """The whole number of n, at least 3, made odd upwards."""
    k = max(3, int(n))
    return k + 1 - k % 2


def grey(image: np.ndarray) -> np.ndarray:
    """The grey levels of a colour image, rows by columns by red, green and blue."""
    if image.ndim == 2:
        return image
    parts = sum(image[..., i].astype("int64") * w for i, w in enumerate(GREY_WEIGHTS))
    return ((parts + (1 << (GREY_BITS - 1))) >> GREY_BITS).astype("uint8")


def _shares(size: int, parts: int) -> np.ndarray:
    """How much of each of size cells lies in each of parts equal stretches, as shares of a stretch."""
    edges = np.linspace(0, size, parts + 1)
    cells = np.arange(size)
    held = np.minimum(cells + 1, edges[1:, None]) - np.maximum(cells, edges[:-1, None])
    return np.clip(held, 0, None) * parts / size


def background(levels: np.ndarray) -> int:
    """The median grey level of the image at a quarter of its size, each of whose pixels is the mean of what it covers."""
    h, w = levels.shape
    small = _shares(h, max(1, h // 4)) @ levels.astype("float64") @ _shares(w, max(1, w // 4)).T
    return int(np.median(np.rint(small)))


def cleaned(image: np.ndarray) -> np.ndarray:
    """Grey levels with coloured and light pixels (stamps, marks, paper) as background."""
    levels = grey(image)
    drop = levels > LIGHT
    if image.ndim == 3:
        drop |= (image.max(axis=2).astype("int16") - image.min(axis=2)) > COLOUR_SPREAD
    return np.where(drop, np.uint8(background(levels)), levels)


def darker(levels: np.ndarray, block: int, offset: float) -> np.ndarray:
    """Pixels darker by offset or more than the mean of the block by block neighbourhood, the border repeated outwards."""
    half = block // 2
    wide = np.pad(levels.astype("int64"), half, mode="edge").cumsum(0).cumsum(1)
    wide = np.pad(wide, ((1, 0), (1, 0)))
    total = wide[block:, block:] - wide[:-block, block:] - wide[block:, :-block] + wide[:-block, :-block]
    return levels <= np.rint(total / block**2) - offset


def _runs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of True begin and end."""
    edge = np.diff(np.concatenate([[0], row.astype("int8"), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def long_runs(mask: np.ndarray, least: int) -> np.ndarray:
    """Only the pixels in horizontal runs of least pixels or more: an opening by a line."""
    out = np.zeros_like(mask)
    for y in np.flatnonzero(mask.any(1)):
        for a, b in zip(*_runs(mask[y]), strict=True):
            if b - a >= least:
                out[y, a:b] = True
    return out


def spread(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    """Every pixel made a rectangle of width by height around it."""
    def along(m: np.ndarray, size: int) -> np.ndarray:
        total = np.pad(m.astype("int32"), ((0, 0), (size // 2 + 1, size - 1 - size // 2))).cumsum(1)
        return total[:, size:] - total[:, :-size] > 0

    return along(along(mask, width).T, height).T


def closed(mask: np.ndarray, gap: int) -> np.ndarray:
    """Gaps of fewer than gap pixels along the rows, between pixels that are set, filled."""
    out = mask.copy()
    for y in np.flatnonzero(mask.any(1)):
        begins, ends = _runs(mask[y])
        for a, b in zip(ends[:-1], begins[1:], strict=True):
            if b - a < gap:
                out[y, a:b] = True
    return out


def components(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (x1, y1, x2, y2) of what hangs together, corners included, in order of their first pixels."""
    parent: list[int] = []
    box: list[list[int]] = []
    above: list[tuple[int, int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(mask.shape[0]):
        row: list[tuple[int, int, int]] = []
        for a, b in zip(*(x.tolist() for x in _runs(mask[y])), strict=True):
            near = sorted({root(k) for c, d, k in above if c <= b and d >= a})
            if near:
                own = near[0]
                for k in near[1:]:
                    parent[k] = own
                    box[own] = [min(box[own][0], box[k][0]), min(box[own][1], box[k][1]), max(box[own][2], box[k][2]), max(box[own][3], box[k][3])]
                box[own] = [min(box[own][0], a), box[own][1], max(box[own][2], b), y + 1]
            else:
                own = len(parent)
                parent.append(own)
                box.append([a, y, b, y + 1])
            row.append((a, b, own))
        above = row
    return [tuple(box[i]) for i in range(len(parent)) if parent[i] == i]


def outermost(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Boxes that lie in no other."""
    inside = lambda a, b: a != b and a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2] and a[3] <= b[3]
    return [a for a in found if not any(inside(a, b) for b in found)]


def row_bands(active: np.ndarray, gap: int, pad: int = PAD) -> list[tuple[int, int]]:
    """(top, bottom) of the bands of a page whose rows with lines are active; boxes.bands is the same over tables."""
    rows, height = np.flatnonzero(active), len(active)
    if not len(rows):
        return [(0, height)]
    cut = np.flatnonzero(np.diff(rows) > gap)
    firsts, lasts = rows[np.concatenate([[0], cut + 1])], rows[np.concatenate([cut, [len(rows) - 1]])]
    if len(firsts) == 1:
        return [(0, height)]
    out = []
    for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
        end = b + gap // 2 + 1
        out.append((max(0, max(0, a - (gap - 1) // 2) - pad), height if end >= height else min(height, end + pad)))
    return out


def full_lines(lines: np.ndarray, area: tuple[int, int, int, int], dpi: int) -> int:
    """Horizontal lines that go through SPAN of an area's width, small gaps in them filled; slanting ones count by their width."""
    x1, y1, x2, y2 = area
    length = x2 - x1
    if length <= 2 * max(5, int(EDGE * dpi)):
        return 0
    part = closed(lines[y1:y2, x1:x2], max(3, int(GAP * dpi)))
    return sum(b[2] - b[0] >= max(1, int(SPAN * length)) for b in components(part))


def table_candidates(image: np.ndarray, dpi: int = DPI) -> list[dict]:
    """x1, y1, x2, y2, n_h, n_v, depth of everything on a page that may be a table: grids with LEAST_LINES lines through it.

    Lines are found by runs of dark pixels. In each band of rows the grid is spread until its parts hang together; in
    every part the same is done again, half as wide and SHRINK further in, down to MOST_DEPTH. What is a frame and
    what a table is decided on the boxes afterwards (boxes.table_boxes).
    """
    dark = darker(image, odd(LINE_BLOCK * dpi), LINE_OFFSET)
    least = int(LINE * dpi)
    across, down = long_runs(dark, least), long_runs(dark.T, least).T
    grid = across | down
    height, width = grid.shape
    min_w, min_h = round(LEAST_WIDTH * dpi), round(LEAST_HEIGHT * dpi)
    found: list[dict] = []
    open_ = [((0, top, width, bottom), 0) for top, bottom in reversed(row_bands(across.any(1), int(LINE_BLOCK * dpi)))]
    while open_:
        (rx1, ry1, rx2, ry2), depth = open_.pop()
        if rx2 - rx1 < min_w or ry2 - ry1 < min_h:
            continue
        size = 2 * max(3, round(SPREAD * 0.5**depth * dpi)) - 1
        for x1, y1, x2, y2 in outermost(components(spread(grid[ry1:ry2, rx1:rx2], size, size))):
            if x2 - x1 < min_w or y2 - y1 < min_h:
                continue
            whole = (rx1 + x1, ry1 + y1, rx1 + x2, ry1 + y2)
            box = (max(0, whole[0] - PAD), max(0, whole[1] - PAD), min(width, whole[2] + PAD), min(height, whole[3] + PAD))
            n_h = full_lines(across, box, dpi)
            n_v = full_lines(down.T, (box[1], box[0], box[3], box[2]), dpi)
            if max(n_h, n_v) >= LEAST_LINES:
                found.append({"x1": box[0], "y1": box[1], "x2": box[2], "y2": box[3], "n_h": n_h, "n_v": n_v, "depth": depth})
            if depth < MOST_DEPTH:
                open_.append(((whole[0] + SHRINK, whole[1] + SHRINK, whole[2] - SHRINK, whole[3] - SHRINK), depth + 1))
    return sorted(found, key=lambda b: b["depth"])


def with_border(image: np.ndarray, thickness: int = 2) -> np.ndarray:
    """The image with a black frame of thickness pixels along its edges."""
    out = grey(image).copy()
    for part in (out[:thickness], out[-thickness:], out[:, :thickness], out[:, -thickness:]):
        part[...] = 0
    return out


def without_stamp(image: np.ndarray, frame: tuple[int, int, int, int]) -> np.ndarray:
    """The image with everything right of, below and left of the frame white; what stands above stays."""
    x1, _, x2, y2 = frame
    out = image.copy()
    out[:, max(0, x2 - 2) :] = 255
    out[max(0, y2 - 2) :] = 255
    out[:, : x1 + 3] = 255
    return out


def stamp_frames(frames: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x1, y1, x2, y2): the frame of each page that has a stamp below it.

    frames has boxes of four-cornered outlines, page_w and page_h; the frame is the smallest of more than half of the
    page that isn't far from square. cells has boxes of outlines the size of a stamp's cells; it takes STAMP_CELLS of
    them below the frame, from its left edge on.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    large = frames.filter((w * h > STAMP_FRAME * F.col("page_w") * F.col("page_h")) & (w / h > STAMP_ASPECT[0]) & (w / h < STAMP_ASPECT[1]))
    own = large.groupBy(*keys).agg(F.min(F.struct((w * h).alias("size"), "x1", "y1", "x2", "y2")).alias("f")).select(*keys, "f.x1", "f.y1", "f.x2", "f.y2")
    below = own.join(cells.select(*keys, F.col("x1").alias("__x"), F.col("y1").alias("__y")), keys).filter("__y >= y2 and __x >= x1")
    return below.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.count("*").alias("__n")).filter(F.col("__n") >= STAMP_CELLS).drop("__n")


def decoded(content: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """The array of a page's raw pixels."""
    pixels = np.frombuffer(content, "uint8")
    return pixels.reshape(height, width) if channels == 1 else pixels.reshape(height, width, channels)


def page_boxes(pages: DataFrame, dpi: int = DPI) -> DataFrame:
    """(file_id, page, box_id, x1, y1, x2, y2, n_h, n_v, depth): candidates for tables on every page; pages has file_id, page, height, width, channels and content, raw pixels by rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p, content, h, w, c in zip(b["file_id"], b["page"], b["content"], b["height"], b["width"], b["channels"], strict=True):
                found = table_candidates(cleaned(decoded(content, h, w, c)), dpi)
                rows += [(k, p, i, *(f[x] for x in ("x1", "y1", "x2", "y2", "n_h", "n_v", "depth"))) for i, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=["file_id", "page", "box_id", "x1", "y1", "x2", "y2", "n_h", "n_v", "depth"])

    return pages.filter("content is not null").select("file_id", "page", "content", "height", "width", "channels").mapInPandas(run, "file_id long, page int, box_id long, x1 long, y1 long, x2 long, y2 long, n_h int, n_v int, depth int")


Engine = Callable[[np.ndarray], str]


def page_words(pages: DataFrame, engine: Engine) -> DataFrame:
    """(file_id, page, ord, value, confidence, x1, y1, x2, y2): the words of each page, recognised once by the engine, which takes a cleaned page and gives XML of words; every later cut is taken from this table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["file_id"], b["page"], b["content"], b["height"], b["width"], b["channels"], strict=True)
            yield pd.DataFrame([(k, p, engine(cleaned(decoded(x, h, w, c)))) for k, p, x, h, w, c in rows], columns=["file_id", "page", "xml"])

    xml = pages.filter("content is not null").select("file_id", "page", "content", "height", "width", "channels").mapInPandas(run, "file_id long, page int, xml string")
    return recognised_words(xml.withColumn("__k", F.struct("file_id", "page")), "__k", "xml").select("__k.*", "ord", "value", "confidence", "x1", "y1", "x2", "y2")


def page_parts(words: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rest, before, inside): the text of each page outside its tables, the last 50 characters of what stands in the 100 pixels above each table, and the words of each table with places counted from its corner.

    words as page_words gives them, tables with file_id, page, box_id and a box; tables smaller than ten pixels don't
    count. A table at the page's top has no text before it.
    """
    keys = ["file_id", "page"]
    own = boxes.large_enough(tables)
    placed = own.select(*keys, "box_id", *(F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), " ")
    rest = boxes.words_outside(words, placed, keys).filter("value is not null").groupBy(*keys).agg(joined.alias("text"))
    above = words.join(placed.filter("by1 > 100"), keys).filter("value is not null and y1 >= by1 - 100 and y2 <= by1")
    before = above.groupBy(*keys, "box_id").agg(joined.alias("t")).select(*keys, "box_id", F.expr("right(t, 50)").alias("before"))
    return rest, before, boxes.words_in_boxes(words, placed, keys)
