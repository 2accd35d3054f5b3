"""The whole preparation of foot images as one composition of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solea.operators import pixels as X
from solea.operators import regions as G
from solea.operators.segmentation import segment_foot
from solea.session import cut_lineage
from solea.sources.images import quarantine


def prepare_feet(px: DataFrame, target: int = 224, clip: float = 3.5, tiles: int = 8, least_kernel: int = 10, kernel_width: int = 5,
                 seed: int = 42, key: list[str] = X.IMAGE) -> tuple[DataFrame, DataFrame]:
    """RGB pixel rows to prepared feet.

    Returns pixel rows ``(key, foot, kind, row_no, col_no, r, g, b)`` with kind ``model`` (target x target, scaled to
    [0, 1]), ``full`` (equalised, full size) and ``original`` (colour crop, same size as full), and one status row per
    image and foot. Images that are faulty, or have fewer than two regions, have one status row with an error and no
    pixels; they do not touch the others.
    """
    px, faulty = quarantine(px, ["r", "g", "b"], key)
    seg = segment_foot(px, seed=seed, key=key)
    sole = cut_lineage(X.mask_image(seg, F.col("mask"), ["r", "g", "b"]).select(*key, "row_no", "col_no", "r", "g", "b"))
    lit = sole.withColumn("mask", F.col("r") + F.col("g") + F.col("b") > 0)
    boxes = G.component_boxes(G.component_runs(lit, 8, key, (lambda height: G.kernel_height(height, least=least_kernel), kernel_width)), key)
    feet = cut_lineage(G.split_feet(boxes, sole, key))  # a few rows per image, read by the crops and the status rows
    wide = [*key, "foot"]
    original = cut_lineage(G.crop_squares(sole, feet, ["r", "g", "b"], key))
    full = cut_lineage(X.clahe(X.grayscale(original).select(*wide, "row_no", "col_no", "v"), clip, tiles, wide))
    model = X.scale_255(X.resize_bilinear(full, target, wide))
    grey = lambda df, kind: df.select(*wide, F.lit(kind).alias("kind"), "row_no", "col_no", *[F.col("v").cast("double").alias(c) for c in "rgb"])
    colour = original.select(*wide, F.lit("original").alias("kind"), "row_no", "col_no", *[F.col(c).cast("double").alias(c) for c in "rgb"])
    return grey(model, "model").unionByName(grey(full, "full")).unionByName(colour), feet.unionByName(faulty, allowMissingColumns=True)
