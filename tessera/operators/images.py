"""Numeric images as pixel relations (image_id, y, x, v): arithmetic, clipped statistics, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_shape(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels that only one of two images has; empty if their shapes agree."""
    key = ["y", "x"]
    return a.select(*key).join(b.select(*key), key, "left_anti").union(b.select(*key).join(a.select(*key), key, "left_anti"))


def combine(a: DataFrame, b: DataFrame, operation: str) -> DataFrame:
    """``subtract`` or ``divide`` (null where the divisor is 0) pixel by pixel."""
    if operation not in ("subtract", "divide"):
        raise ValueError(operation)
    rows = a.select("y", "x", F.col("v").alias("a")).join(b.select("y", "x", F.col("v").alias("b")), ["y", "x"])
    v = F.col("a") - F.col("b") if operation == "subtract" else F.try_divide("a", "b")
    return rows.select("y", "x", v.alias("v"))


def clipped_stats(pixels: DataFrame, group: str = "image_id", sigma: float = 3.0, rounds: int = 3) -> DataFrame:
    """Mean, deviation and count of each image after leaving out values beyond ``sigma`` deviations, ``rounds`` times."""
    rows = pixels.select(group, "v")
    for _ in range(rounds):
        s = rows.groupBy(group).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
        rows = rows.join(s, group).where(F.abs(F.col("v") - F.col("m")) <= sigma * F.col("d")).select(group, "v")
    return rows.groupBy(group).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.count("*").alias("n"))


def bright(pixels: DataFrame, stats: DataFrame, times: float = 5.0, group: str = "image_id") -> DataFrame:
    """Pixels above the clipped mean by ``times`` deviations: candidate point sources."""
    return pixels.join(stats, group).where(F.col("v") > F.col("mean") + times * F.col("deviation")).select(group, "y", "x", "v")


def refine_boxes(boxes: DataFrame, parts: DataFrame, cell: float = 64.0) -> DataFrame:
    """Each box (page, box_id, x0, y0, x1, y1) fitted to the drawings (page, px0, py0, px1, py1) that overlap it; itself without any.

    Boxes and drawings meet in the cells of a grid that both touch, not in all pairs of a
    page; meeting in several cells changes neither least nor greatest. Boxes and drawings of a page that
    lie alike are one shape each, and only shapes meet: copies, however many, make no pairs.
    """
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    grid = lambda rows, p: rows.withColumn("cx", cells(f"{p}x0", f"{p}x1")).withColumn("cy", cells(f"{p}y0", f"{p}y1"))
    corners = ["page", "x0", "y0", "x1", "y1"]
    shapes = boxes.select(*corners).distinct()
    drawn = parts.where("px0 <= px1 AND py0 <= py1").select("page", "px0", "py0", "px1", "py1").distinct()
    hit = grid(shapes, "").join(grid(drawn, "p"), ["page", "cx", "cy"]).where("px0 < x1 AND px1 > x0 AND py0 < y1 AND py1 > y0")
    fit = hit.groupBy(*corners).agg(F.min("px0").alias("a"), F.min("py0").alias("b"), F.max("px1").alias("c"), F.max("py1").alias("d"))
    out = boxes.join(fit, corners, "left")
    return out.select("page", "box_id", *(F.coalesce(n, o).alias(o) for n, o in zip("abcd", ("x0", "y0", "x1", "y1"))))


#: How far above its caption a figure may begin, the gap between them, the margin at the sides.
ABOVE, GAP, MARGIN = 400, 5, 20


def caption_regions(captions: DataFrame, least_width: float = 150, least_height: float = 100) -> DataFrame:
    """Where the figure of each caption (page, block, x0, y0, x1, y1, page_width) should stand: page, block, x0, y0, x1, y1.

    Above the caption, as wide as it with a margin, widened about its middle where that is too
    narrow; none where the page leaves no room above.
    """
    left, right = F.greatest(F.lit(0), F.col("x0") - MARGIN), F.least(F.col("page_width"), F.col("x1") + MARGIN)
    narrow, middle = right - left < least_width, (left + right) / 2
    top, bottom = F.greatest(F.lit(0), F.col("y0") - ABOVE), F.col("y0") - GAP
    out = captions.select(
        "page", "block", F.when(narrow, F.greatest(F.lit(0), middle - least_width / 2)).otherwise(left).alias("x0"), top.alias("y0"),
        F.when(narrow, F.least(F.col("page_width"), middle + least_width / 2)).otherwise(right).alias("x1"), bottom.alias("y1"),
    )
    return out.where(F.col("y1") > F.col("y0") + least_height)


def nearby_captions(boxes: DataFrame, lines: DataFrame, margin: float = 50, below: float = 100, above: float = 80) -> DataFrame:
    """Text that stands near each figure (page, box_id, x0, y0, x1, y1) and may be its caption: page, box_id, caption.

    ``lines`` (page, line, x0, y0, x1, y1, text). First what lies below, then what lies
    above; the first of them that speaks of a figure or table, up to the first sentence's end within
    five lines; else the first of more than 20 characters, cut to 300. The lines of one page are read together.
    """
    line = lines.select("page", "line", "text", *(F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")))
    near = boxes.join(line, "page").where((F.col("lx0") < F.col("x1") + margin) & (F.col("lx1") > F.col("x0") - margin))
    side = F.when((F.col("ly0") < F.col("y1") + below) & (F.col("ly1") > F.col("y1")), 0).when((F.col("ly0") < F.col("y0")) & (F.col("ly1") > F.col("y0") - above), 1)
    near = near.withColumn("side", side).where("side IS NOT NULL AND trim(text) <> ''")
    texts = near.groupBy("page", "box_id", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim("text").alias("text")))), lambda x: x["text"]).alias("parts"))
    marked = F.lower(F.array_join("parts", "\n")).rlike("figure|fig\\.|fig |table|diagram|chart")
    head = F.slice("parts", 1, 5)
    ends = F.array_position(F.transform(head, lambda x: F.endswith(x, F.lit("."))), True)
    caption = F.when(marked, F.substring(F.array_join(F.when(ends > 0, F.slice(head, F.lit(1), ends.cast("int"))).otherwise(head), " "), 1, 500))
    plain = F.when(F.length(F.array_join("parts", "\n")) > 20, F.substring(F.array_join("parts", "\n"), 1, 300))
    best = texts.groupBy("page", "box_id").agg(F.min_by(caption, F.when(marked, F.col("side"))).alias("marked"), F.min_by(plain, F.when(plain.isNotNull(), F.col("side"))).alias("plain"))
    return boxes.select("page", "box_id").join(best, ["page", "box_id"], "left").select("page", "box_id", F.coalesce("marked", "plain", F.lit("")).alias("caption"))
