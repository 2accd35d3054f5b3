"""Saliency maps from activation and gradient tables ``(image_id, ch, h, w, act, grad)``, and the pointing game."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from solea.functions.batches import starts, whole_groups
from solea.operators.boxes import points_in_box
from solea.operators.pixels import _both_axes
from solea.session import cut_lineage

_EPS = 1e-8


# A map has a fixed number of cells and a channel holds one value per cell, so these windows stay small.
def _channel() -> WindowSpec:
    return Window.partitionBy("image_id", "ch")


def _weighted_map(weighted: DataFrame) -> DataFrame:
    """ReLU of the channel-weighted sum, scaled by the image maximum."""
    cam = weighted.groupBy("image_id", "h", "w").agg(
        F.greatest(F.sum(F.col("act") * F.col("weight")), F.lit(0.0)).alias("cam")
    )
    return cam.withColumn("cam", F.col("cam") / (F.max("cam").over(Window.partitionBy("image_id")) + _EPS))


def grad_cam(maps: DataFrame) -> DataFrame:
    return _weighted_map(maps.withColumn("weight", F.avg("grad").over(_channel())))


def grad_cam_pp(maps: DataFrame) -> DataFrame:
    g = F.col("grad")
    den = 2.0 * g * g + F.sum("act").over(_channel()) * g * g * g
    part = g * g / F.when(F.abs(den) > _EPS, den).otherwise(_EPS) * F.greatest(g, F.lit(0.0))
    return _weighted_map(maps.withColumn("__part", part).withColumn("weight", F.sum("__part").over(_channel())))


def eigen_cam(maps: DataFrame) -> DataFrame:
    """First left singular vector of the channel-centred map matrix; the entry of largest size is made positive.

    The map stacks of many images are decomposed together; a stack has the same cells in every channel.
    """

    def leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["image_id"]):
            first = np.flatnonzero(starts(pdf, ["image_id"]).to_numpy())
            size, channels = np.diff(np.append(first, len(pdf))), np.add.reduceat(starts(pdf, ["image_id", "ch"]).to_numpy(np.int64), first)
            act = pdf["act"].to_numpy(np.float64)
            for n, k in set(zip(size.tolist(), channels.tolist())):
                own = first[(size == n) & (channels == k)]
                stack = act[own[:, None] + np.arange(n)].reshape(len(own), k, n // k)
                centred = stack - stack.mean(axis=2, keepdims=True)
                u = np.linalg.svd(centred.transpose(0, 2, 1), full_matrices=False)[0][:, :, 0]
                top = np.take_along_axis(u, np.abs(u).round(12).argmax(axis=1)[:, None], axis=1)
                u = u * np.where(top >= 0, 1.0, -1.0)
                u = u - u.min(axis=1, keepdims=True)
                where = pdf.iloc[(own[:, None] + np.arange(n // k)).ravel()]
                yield pd.DataFrame({c: where[c].to_numpy() for c in ("image_id", "h", "w")} | {"cam": (u / (u.max(axis=1, keepdims=True) + _EPS)).ravel()})

    dealt = maps.select("image_id", "ch", "h", "w", "act").repartition("image_id").sortWithinPartitions("image_id", "ch", "h", "w")
    return dealt.mapInPandas(leading, "image_id bigint, h int, w int, cam double")


def upsample_map(cam: DataFrame, target: int = 224) -> DataFrame:
    """Bilinear upsampling with half-pixel centres."""
    def per_line(line: Column) -> Column:
        n = F.size(line)

        def one(o: Column) -> Column:
            at = (o + 0.5) * n / F.lit(float(target)) - 0.5
            low = F.floor(at).cast("int")
            a = F.get(line, F.greatest(low, F.lit(0))).cast("double")
            b = F.get(line, F.least(low + 1, n - 1)).cast("double")
            return a + (b - a) * (at - low)

        return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), one)

    grid = cam.select("image_id", F.col("h").alias("row_no"), F.col("w").alias("col_no"), "cam")
    return _both_axes(grid, ["image_id"], "cam", per_line)


def high_activation(cam: DataFrame, share: float = 0.95) -> DataFrame:
    """Pixels at or above the image's percentile. A map has a fixed number of cells, so the exact percentile is small."""
    cut = F.percentile(F.round("cam", 9), F.lit(share)).over(Window.partitionBy("image_id"))
    return cam.withColumn("cut", cut).filter(F.round("cam", 9) >= F.col("cut"))


def pointing_game(cams: dict[str, DataFrame], boxes: DataFrame, target: int = 224) -> DataFrame:
    """Hit per method and annotated box: does any high-activation pixel fall inside the expanded box?"""
    out = None
    for method, cam in cams.items():
        cam = cut_lineage(cam)  # small maps, read several times below
        high = high_activation(upsample_map(cam, target)).select("image_id", "row_no", "col_no")
        hit = points_in_box(high, boxes).select("box_id").distinct().withColumn("hit", F.lit(1))
        seen = boxes.select("box_id", "image_id").join(cam.select("image_id").distinct(), "image_id", "left_semi")
        rows = seen.join(hit, "box_id", "left").select(F.lit(method).alias("method"), "box_id", F.coalesce("hit", F.lit(0)).alias("hit"))
        out = rows if out is None else out.unionByName(rows)
    return out


def hit_rate(hits: DataFrame) -> DataFrame:
    return hits.groupBy("method").agg(F.avg("hit").alias("rate"), F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
