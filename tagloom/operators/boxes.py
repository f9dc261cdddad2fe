"""Rectangles on pages: words inside and outside boxes, duplicates, wrappers, bands, double pages. Coordinates grow right and down."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------
DPI = 288
SAME_BOX, WRAPPER_SHARE, PAD = 0.9, 0.85, 3
SHRINK = max(2 * PAD, round(0.06 * DPI))  # by how much a drill-down moves every side, a level
SHADOW = max(2 * PAD, SHRINK // 2)
HOLD = max(4 * PAD, SHRINK)
LEAST_FRAME, FRAME_FILLED = 0.25, 1.2
FRAME_SHARE, FRAME_RATIO, FRAME_OVERLAP = (0.40, 0.55), 1.2, 0.05
BAND_GAP = int(0.25 * DPI)
# --------------------------------------------------------------------------------------------------


def large_enough(boxes: DataFrame, least: int = 10) -> DataFrame:
    """Boxes with both sides of least pixels or more."""
    return boxes.filter((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def words_in(words: DataFrame, rect: tuple[int, int, int, int], keys: list[str]) -> DataFrame:
    """(keys, text): the words wholly inside the rectangle, joined in their order."""
    x1, y1, x2, y2 = rect
    inside = words.filter((F.col("x1") >= x1) & (F.col("x2") <= x2) & (F.col("y1") >= y1) & (F.col("y2") <= y2) & F.col("value").isNotNull())
    return inside.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), " ").alias("text"))


def _centre_in(words: DataFrame, boxes: DataFrame, keys: list[str]) -> Column:
    on = (words["x1"] + words["x2"] >= 2 * boxes["bx1"]) & (words["x1"] + words["x2"] <= 2 * boxes["bx2"]) & (words["y1"] + words["y2"] >= 2 * boxes["by1"]) & (words["y1"] + words["y2"] <= 2 * boxes["by2"])
    for k in keys:
        on = on & (words[k] == boxes[k])
    return on


def words_outside(words: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Words whose centre lies in none of their page's boxes; the border belongs to a box."""
    return words.join(boxes, _centre_in(words, boxes, keys), "left_anti")


def words_in_boxes(words: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Words whose centre lies in a box, with coordinates counted from the box's corner."""
    j = words.join(boxes, _centre_in(words, boxes, keys))
    return j.select(*(words[k] for k in keys), words["ord"], boxes["box_id"], *((words[c] - boxes[f"b{c[0]}1"]).alias(c) for c in ("x1", "y1", "x2", "y2")))


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Shared area over joint area; 0 for boxes that only touch or don't meet."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    shared = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))
    return shared / (area(*a) + area(*b) - shared)


def _pair(boxes: DataFrame, keys: list[str]) -> DataFrame:
    a = boxes.select(*keys, *(F.col(c).alias(f"a_{c}") for c in ("box_id", "x1", "y1", "x2", "y2", "depth")))
    b = boxes.select(*keys, *(F.col(c).alias(f"b_{c}") for c in ("box_id", "x1", "y1", "x2", "y2", "depth")))
    return a.join(b, keys)


def _of(side: str) -> list[Column]:
    return [F.col(f"{side}_{c}") for c in ("x1", "y1", "x2", "y2")]


def overlaps(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, box_a, box_b, iou) of the pairs of boxes of one page that share area."""
    pairs = _pair(boxes, keys).filter("a_box_id < b_box_id").withColumn("iou", F.round(iou(_of("a"), _of("b")), 6))
    return pairs.filter("iou > 0").select(*keys, F.col("a_box_id").alias("box_a"), F.col("b_box_id").alias("box_b"), "iou")


def holds(a: list[Column], b: list[Column], tolerance: int = HOLD) -> Column:
    """b lies in a, give or take the tolerance at every side."""
    return (a[0] <= b[0] + tolerance) & (a[1] <= b[1] + tolerance) & (a[2] >= b[2] - tolerance) & (a[3] >= b[3] - tolerance)


def is_shadow(a: list[Column], b: list[Column], deeper: Column) -> Column:
    """b, found deeper levels below a, is what a drill-down leaves of a: every side moved in by SHRINK a level, within SHADOW."""
    moved = deeper * SHRINK
    out = deeper > 0
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        out = out & (F.abs((x + moved if i < 2 else x - moved) - y) <= SHADOW)
    return out


def without_wrappers(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes but for those that hold another, clearly smaller one which is no shadow of them; takes deduplicated boxes."""
    smaller = area(*_of("b")) < WRAPPER_SHARE * area(*_of("a"))
    shadow = is_shadow(_of("a"), _of("b"), F.col("b_depth") - F.col("a_depth"))
    wrappers = _pair(boxes, keys).filter(F.col("a_box_id") != F.col("b_box_id")).filter(holds(_of("a"), _of("b")) & smaller & ~shadow).select(*keys, F.col("a_box_id").alias("box_id")).distinct()
    return boxes.join(wrappers, [*keys, "box_id"], "left_anti")


def keep_first(rows: list[tuple]) -> list[int]:
    """Ids of (id, depth, x1, y1, x2, y2) kept in order: a box goes if it nearly is one already kept, or the shadow of one."""
    kept: list[tuple] = []
    for r in rows:
        _, depth, x1, y1, x2, y2 = r
        for _, d, a1, b1, a2, b2 in kept:
            w, h = min(x2, a2) - max(x1, a1), min(y2, b2) - max(y1, b1)
            shared = w * h if w > 0 and h > 0 else 0
            joint = (x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - shared
            m = (depth - d) * SHRINK
            shadow = depth > d and max(abs(a1 + m - x1), abs(b1 + m - y1), abs(a2 - m - x2), abs(b2 - m - y2)) <= SHADOW
            if shadow or (joint and shared / joint > SAME_BOX):
                break
        else:
            kept.append(r)
    return [k[0] for k in kept]


def dedupe(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, box_id) of the boxes kept when each page's boxes are taken by depth; greedy, so it runs over each page's boxes in order."""

    @F.pandas_udf("array<long>")
    def kept(pages: pd.Series) -> pd.Series:
        return pd.Series([keep_first([tuple(b[c] for c in ("box_id", "depth", "x1", "y1", "x2", "y2")) for b in page]) for page in pages])

    pages = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("depth", "box_id", "x1", "y1", "x2", "y2"))).alias("boxes"))
    return pages.select(*keys, F.explode(kept("boxes")).alias("box_id"))


def table_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The boxes of tables: deduplicated, then without wrappers."""
    return without_wrappers(boxes.join(dedupe(boxes, keys), [*keys, "box_id"], "left_semi"), keys)


def bands(rows: DataFrame, pages: DataFrame, keys: list[str], gap: int = BAND_GAP, pad: int = PAD) -> DataFrame:
    """(keys, band, top, bottom): the stretches of each page, of height rows, that hold lines; rows has the active y.

    Every active row widens by half of gap to both sides, and what then hangs together is a band, wider by pad within
    the page; one that reaches the last row ends there. A page of one band or none is one band as a whole. Gaps and
    islands by window.
    """
    w = Window.partitionBy(*keys).orderBy("y")
    marked = rows.select(*keys, "y").distinct().withColumn("new", F.coalesce((F.col("y") - F.lag("y").over(w) > gap).cast("int"), F.lit(0)))
    runs = marked.withColumn("band", F.sum("new").over(w)).groupBy(*keys, "band").agg(F.min("y").alias("first"), F.max("y").alias("last"))
    n = F.count("*").over(Window.partitionBy(*keys))
    found = pages.select(*keys, "height").join(runs, keys, "left").withColumn("n", n)
    end = F.col("last") + gap // 2 + 1
    bottom = F.when(F.col("n") == 1, F.col("height")).when(end >= F.col("height"), F.col("height")).otherwise(F.least(F.col("height"), end + pad))
    top = F.when(F.col("n") == 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.greatest(F.lit(0), F.col("first") - (gap - 1) // 2) - pad))
    return found.select(*keys, F.coalesce("band", F.lit(0)).cast("long").alias("band"), top.cast("long").alias("top"), bottom.cast("long").alias("bottom"))


def double_pages(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Pages, as keys, that hold two pages side by side.

    frames has boxes, page_w, page_h, and may have contour, the area within the frame's outline. Frames of less than
    LEAST_FRAME of the page, or far from rectangular, don't count; of the rest there must be two, each about half of
    the page, alike in size, one in each half, hardly overlapping.
    """
    size = area(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    whole = F.col("page_w") * F.col("page_h")
    square = (F.col("contour") >= 1) & (size / F.col("contour") <= FRAME_FILLED) if "contour" in frames.columns else F.lit(True)
    large = frames.filter((size >= LEAST_FRAME * whole) & square)
    two = large.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x1", "x2", size.alias("size")))).alias("f"), F.first("page_w").alias("w"), F.first(whole).alias("whole")).filter(F.size("f") == 2)
    a, b = F.get("f", F.lit(0)), F.get("f", F.lit(1))
    least, most = F.least(a["size"], b["size"]), F.greatest(a["size"], b["size"])
    middle = lambda x: (x["x1"] + x["x2"]) / 2
    half = (least > FRAME_SHARE[0] * F.col("whole")) & (most < FRAME_SHARE[1] * F.col("whole")) & (most / least <= FRAME_RATIO)
    sides = (middle(a) < F.col("w") * 0.5) & (middle(b) > F.col("w") * 0.5)
    apart = F.greatest(F.lit(0), a["x2"] - b["x1"]) <= FRAME_OVERLAP * F.least(a["x2"] - a["x1"], b["x2"] - b["x1"])
    return two.filter(half & sides & apart).select(*keys)


def logical_pages(sheets: DataFrame, key: str, doubles: DataFrame) -> DataFrame:
    """(key, phys_page, sub, logical_page): pages numbered from 0 in order, where a double sheet (key, phys_page in doubles) counts as two."""
    d = doubles.select(key, "phys_page").distinct().withColumn("two", F.lit(True))
    each = sheets.select(key, "phys_page").join(d, [key, "phys_page"], "left").select(key, "phys_page", F.explode(F.when(F.col("two"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("sub"))
    w = Window.partitionBy(key).orderBy("phys_page", "sub")
    return each.withColumn("logical_page", (F.row_number().over(w) - 1).cast("long"))
