"""Annotation boxes: coordinate changes and pixel lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roi_to_model(boxes: DataFrame, target: int = 224) -> DataFrame:
    """Raw-image boxes to model input: minus crop offset, plus padding, scaled, rounded half to even."""
    scale = F.lit(float(target)) / F.col("square_size")
    put = lambda c: F.bround(c, 0).cast("int")
    return boxes.withColumns({
        "mx": put((F.col("x") - F.col("x_min") + F.col("pad_left")) * scale),
        "my": put((F.col("y") - F.col("y_min") + F.col("pad_top")) * scale),
        "mw": put(F.col("w") * scale), "mh": put(F.col("h") * scale),
    })


def roi_mirror(boxes: DataFrame, width: int = 224, x: str = "mx", w: str = "mw") -> DataFrame:
    return boxes.withColumn(x, width - F.col(x) - F.col(w))


def scale_expand(boxes: DataFrame, target: int = 224, tau: int = 15) -> DataFrame:
    """Corners scaled to the target grid by truncation, grown by tau and clamped to the grid."""
    at = lambda c, size: (c * target / F.col(size)).cast("int")
    low = lambda c: F.greatest(F.lit(0), c - tau)
    high = lambda c: F.least(F.lit(target - 1), c + tau)
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    return boxes.withColumns({
        "bx1": low(at(F.col("x"), "orig_w")), "by1": low(at(F.col("y"), "orig_h")),
        "bx2": high(at(x2, "orig_w")), "by2": high(at(y2, "orig_h")),
    })


def points_in_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points inside their image's boxes, bounds included.

    A box is spread over its pixel rows (at most the grid height), which adds the row to the equi key of the join.
    """
    rows = boxes.withColumn("row_no", F.explode(F.when(F.col("by1") <= F.col("by2"), F.sequence("by1", "by2"))))
    return points.join(rows, ["image_id", "row_no"]).filter(F.col("col_no").between(F.col("bx1"), F.col("bx2")))


def annotation_join(images: DataFrame, annotations: DataFrame, on: str = "filename") -> DataFrame:
    return images.join(annotations, on)


def shape_box(shape: Column) -> Column:
    """Bounding box of a drawn shape by its name; null for unknown shapes."""
    s = lambda f: shape[f]
    name = s("name")
    rx, ry = F.coalesce(s("rx"), s("r")), F.coalesce(s("ry"), s("r"))
    px, py = s("all_points_x"), s("all_points_y")
    box = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return (
        F.when(name == "rect", box(s("x"), s("y"), s("x") + s("width"), s("y") + s("height")))
        .when(name.isin("circle", "ellipse"), box(s("cx") - rx, s("cy") - ry, s("cx") + rx, s("cy") + ry))
        .when(name.isin("polygon", "polyline"), box(F.array_min(px), F.array_min(py), F.array_max(px), F.array_max(py)))
        .when(name == "point", box(s("cx"), s("cy"), s("cx"), s("cy")))
    )
