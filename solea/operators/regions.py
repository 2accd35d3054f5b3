"""Regions of binary masks: components, holes, dilation, foot separation and footprint geometry.

Mask rows are ``(key..., row_no, col_no)`` with a boolean ``mask`` on a dense grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solea.functions.batches import starts, whole_groups
from solea.operators import labelling as L
from solea.operators.pixels import IMAGE, extent
from solea.session import cut_lineage

_ROW = 1 << 20  # pixel number = row * _ROW + column


def runs(mask: DataFrame, key: list[str] = IMAGE) -> DataFrame:
    """Foreground as horizontal runs: one row per unbroken stretch, typically far fewer rows than pixels.

    Rows without ``mask`` tell how far each image row reaches. Images are brought together by the one shuffle here; what follows stays in their partition.
    """
    w = Window.partitionBy(*key, "row_no").orderBy("col_no")
    dealt = mask.select(*key, "row_no", "col_no", "mask").repartition(*key)
    island = dealt.withColumn("__i", F.when(F.col("mask"), F.col("col_no") - F.count_if("mask").over(w)))
    out = island.groupBy(*key, "row_no", "__i").agg(F.min("col_no").alias("start"), F.max("col_no").alias("stop"))
    return out.select(*key, "row_no", "start", "stop", F.col("__i").isNotNull().alias("mask"))


def of_images(mask: DataFrame, key: list[str], work: Callable[[L.Runs], tuple[np.ndarray, dict[str, np.ndarray]]], columns: str) -> DataFrame:
    """Rows ``(key, columns...)`` that ``work`` makes of the foreground runs of many whole images at a time, with the image of each row."""
    types = dict(mask.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in key) + columns

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, key):
            fresh = starts(pdf, key).to_numpy()
            first, image = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            row, start, stop = (pdf[c].to_numpy(np.int64) for c in ("row_no", "start", "stop"))
            size = np.maximum.reduceat(row, first) + 1, np.maximum.reduceat(stop, first) + 1
            kept = pdf["mask"].to_numpy(bool)
            made, values = work(L.Runs(image[kept], row[kept], start[kept], stop[kept], *size))
            yield pdf[key].iloc[first[made]].reset_index(drop=True).assign(**values)

    return runs(mask, key).sortWithinPartitions(*key, "row_no", "start").mapInPandas(lambda batches: step(batches), schema)


def per_image(mask: DataFrame, key: list[str], work: Callable[[L.Runs], tuple[L.Runs, dict[str, np.ndarray]]], more: str) -> DataFrame:
    """Runs ``(key, row_no, start, stop, more...)`` that ``work`` makes of the foreground runs of many whole images at a time."""

    def rows(r: L.Runs) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        made, columns = work(r)
        return made.image, {"row_no": made.row, "start": made.start, "stop": made.stop, **columns}

    return of_images(mask, key, rows, "row_no int, start int, stop int, " + more)


def component_runs(mask: DataFrame, connectivity: int = 8, key: list[str] = IMAGE, kernel: tuple[Callable[[np.ndarray], np.ndarray], int] | None = None) -> DataFrame:
    """Runs with the component they belong to (``comp`` = its first pixel number in row order).

    With ``kernel`` the foreground is dilated first: its height as a function of the images' heights, and its width.
    """

    def label(r: L.Runs):
        if kernel:
            r = L.dilated(r, kernel[0](r.height), kernel[1])
        root = L.components(r, connectivity)
        return r, {"comp": r.row[root] * _ROW + r.start[root]}

    return per_image(mask, key, label, "comp bigint")


def as_pixels(found: DataFrame, key: list[str], *columns: str) -> DataFrame:
    return found.select(*key, "row_no", F.explode(F.sequence("start", "stop")).alias("col_no"), *columns)


def connected_components(mask: DataFrame, connectivity: int = 8, key: list[str] = IMAGE) -> DataFrame:
    """One row per foreground pixel with its component."""
    return as_pixels(component_runs(mask, connectivity, key), key, "comp")


def component_boxes(labelled_runs: DataFrame, key: list[str] = IMAGE) -> DataFrame:
    """Size and half-open bounding box per component."""
    return labelled_runs.groupBy(*key, "comp").agg(
        F.sum(F.col("stop") - F.col("start") + 1).alias("size"), F.min("row_no").alias("y0"), (F.max("row_no") + 1).alias("y1"),
        F.min("start").alias("x0"), (F.max("stop") + 1).alias("x1"),
    )


def two_largest(boxes: DataFrame, key: list[str] = IMAGE, k: int = 2) -> DataFrame:
    """The k largest components per image, later first pixels first on equal size."""
    w = Window.partitionBy(*key).orderBy(F.col("size").desc(), F.col("comp").desc())
    return boxes.withColumn("size_rank", F.row_number().over(w)).filter(F.col("size_rank") <= k)


def _dense(foreground: L.Runs) -> tuple[L.Runs, np.ndarray]:
    """Runs of every pixel, and which of them are foreground."""
    ground = L.complement(foreground)
    whole = L.Runs(*(np.concatenate([getattr(foreground, c), getattr(ground, c)]) for c in ("image", "row", "start", "stop")), foreground.height, foreground.width)
    return whole, np.arange(len(whole.row)) < len(foreground.row)


def fill_holes(mask: DataFrame, key: list[str] = IMAGE) -> DataFrame:
    """Dense ``(key, row_no, col_no, mask)``: background that is not 4-connected to the image border becomes foreground."""

    def fill(r: L.Runs):
        whole, kept = _dense(L.filled(r))
        return whole, {"mask": kept}

    return as_pixels(per_image(mask, key, fill, "mask boolean"), key, "mask")


def _reach(df: DataFrame, line: list[str], at: str, before: Column, after: Column, value: str) -> DataFrame:
    """True where a true cell lies at most ``before`` cells back or ``after`` cells ahead in the line."""
    w = Window.partitionBy(*line).orderBy(at)
    hit = F.when(F.col(value), F.col(at))
    back = F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(hit, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(F.col(at) - back <= before, F.lit(False)) | F.coalesce(ahead - F.col(at) <= after, F.lit(False)))


def dilate_rect(mask: DataFrame, height: Column | int, width: Column | int = 5, key: list[str] = IMAGE) -> DataFrame:
    """Binary dilation by a height x width rectangle, along rows and then along columns.

    An even side reaches one cell further ahead than back, as common n-dimensional image tools do. Sides may be
    columns, so every image can have its own kernel.
    """
    h, w = (F.lit(x) if isinstance(x, int) else x for x in (height, width))
    df = mask.withColumns({"__h": h, "__w": w})
    back = lambda c: F.floor((F.col(c) - 1) / 2)
    fore = lambda c: F.floor(F.col(c) / 2)
    # a cell is set when a set cell lies within the window [i - back, i + fore]
    df = _reach(df, [*key, "row_no"], "col_no", back("__w"), fore("__w"), "mask")
    df = _reach(df, [*key, "col_no"], "row_no", back("__h"), fore("__h"), "mask")
    return df.drop("__h", "__w")


def kernel_height(height: np.ndarray, percent: int = 12, least: int = 10) -> np.ndarray:
    return np.maximum(height * percent // 100, least)


def pad_offsets(h: Column, w: Column) -> dict[str, Column]:
    side = F.greatest(h, w)
    return {"square_size": side, "pad_top": F.floor((side - h) / 2).cast("int"), "pad_left": F.floor((side - w) / 2).cast("int")}


def pad_square(df: DataFrame, key: list[str] = IMAGE) -> DataFrame:
    """Shift pixels to the centre of a square. Added cells are black and stay implicit."""
    size = extent(df, key)
    size = size.withColumns(pad_offsets(F.col("height"), F.col("width")))
    return df.join(size, key).withColumns({"row_no": F.col("row_no") + F.col("pad_top"), "col_no": F.col("col_no") + F.col("pad_left")})


def split_feet(boxes: DataFrame, images: DataFrame, key: list[str] = IMAGE) -> DataFrame:
    """Two crops per image, left by centre first, with padding data; images with fewer than two regions fail."""
    top = two_largest(boxes, key)
    w = Window.partitionBy(*key)
    placed = top.withColumn("found", F.count(F.lit(1)).over(w)).filter(F.col("found") == 2)
    order = Window.partitionBy(*key).orderBy((F.col("x0") + F.col("x1")), F.col("comp"))
    feet = placed.withColumn("foot", F.when(F.row_number().over(order) == 1, "L").otherwise("R"))
    crop_h, crop_w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    feet = feet.withColumns({"crop_h": crop_h, "crop_w": crop_w, **pad_offsets(crop_h, crop_w)})
    feet = feet.select(*key, "foot", F.col("x0").alias("x_min"), F.col("y0").alias("y_min"), "crop_w", "crop_h", "pad_top", "pad_left", "square_size")
    failed = images.select(*key).distinct().join(feet.select(*key), key, "left_anti").withColumn("error", F.lit("fewer than 2 regions"))
    return feet.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def crop_squares(df: DataFrame, feet: DataFrame, channels: list[str], key: list[str] = IMAGE) -> DataFrame:
    """Dense square crops per (image, foot): the crop centred, black cells added around it."""
    good = feet.filter(F.col("error").isNull()).drop("error")
    inside = (F.col("row_no") >= F.col("y_min")) & (F.col("row_no") < F.col("y_min") + F.col("crop_h")) & (F.col("col_no") >= F.col("x_min")) & (
        F.col("col_no") < F.col("x_min") + F.col("crop_w"))
    cells = df.join(good, key).filter(inside).select(
        *key, "foot", (F.col("row_no") - F.col("y_min") + F.col("pad_top")).cast("int").alias("row_no"),
        (F.col("col_no") - F.col("x_min") + F.col("pad_left")).cast("int").alias("col_no"), *channels,
    )
    last = F.col("square_size").cast("int") - 1
    grid = good.select(*key, "foot", last.alias("__m")).select(*key, "foot", "__m", F.explode(F.sequence(F.lit(0), F.col("__m"))).alias("row_no"))
    grid = grid.select(*key, "foot", "row_no", F.explode(F.sequence(F.lit(0), F.col("__m"))).alias("col_no"))
    at = [*key, "foot", "row_no", "col_no"]
    return grid.join(cells, at, "left").select(*at, *[F.coalesce(c, F.lit(0)).alias(c) for c in channels])


# ---------------------------------------------------------------- footprint geometry


_COUNTS = ("regions", "filled_px", "foot_area", "removed_px")


def foot_runs(mask: DataFrame, key: list[str] = IMAGE, later_wins: bool = True) -> DataFrame:
    """Runs of every pixel with ``mask`` true on the foot, and the counts of ``toe_removal`` on each row."""

    def remove(r: L.Runs):
        images = len(r.height)
        whole = L.filled(r)
        root = L.components(whole, 4)
        foot = L.filled(L.largest(whole, root, later_wins))
        regions = np.bincount(whole.image[np.unique(root)], minlength=images)
        dense, kept = _dense(foot)
        area, left = whole.area(images), foot.area(images)  # outside reaches the border with and without the other regions, so the foot stays inside the filled area
        per = {"regions": regions, "filled_px": area, "foot_area": left, "removed_px": area - left}
        return dense, {"mask": kept, **{c: v[dense.image] for c, v in per.items()}}

    return per_image(mask, key, remove, "mask boolean, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def toe_removal(mask: DataFrame, key: list[str] = IMAGE, later_wins: bool = True) -> tuple[DataFrame, DataFrame]:
    """Fill holes, keep the largest 4-connected region and fill it again; also counts per image that has a region.

    Of equally large regions the later one is kept, or the first with ``later_wins=False``.
    """
    found = foot_runs(mask, key, later_wins)
    return as_pixels(found, key, "mask"), found.where("row_no = 0 AND start = 0 AND regions > 0").select(*key, *_COUNTS)


def _banded(rows: DataFrame, key: list[str]) -> DataFrame:
    ends = Window.partitionBy(*key)  # one row per image row
    rows = rows.withColumn("r0", F.min("row_no").over(ends)).withColumn("len", F.max("row_no").over(ends) - F.col("r0") + 1)
    third = lambda m: F.col("r0") + F.floor(m * F.col("len") / 3)
    band = F.when(F.col("row_no") < third(1), "C").when(F.col("row_no") < third(2), "B").otherwise("A")
    return rows.withColumn("band", band).select(*key, "row_no", "band", "width", "area")


def foot_bands(mask: DataFrame, key: list[str] = IMAGE) -> DataFrame:
    """Per row: band (C heel, B middle, A fore) of the trisected row extent, width and area."""
    rows = mask.filter("mask").groupBy(*key, "row_no").agg(
        (F.max("col_no") - F.min("col_no") + 1).alias("width"), F.count(F.lit(1)).alias("area")
    )
    return _banded(rows, key)


def foot_bands_of_runs(found: DataFrame, key: list[str] = IMAGE) -> DataFrame:
    """``foot_bands`` of the runs with ``mask``."""
    rows = found.filter("mask").groupBy(*key, "row_no").agg(
        (F.max("stop") - F.min("start") + 1).alias("width"), F.sum(F.col("stop") - F.col("start") + 1).alias("area")
    )
    return _banded(rows, key)


def footprint_indices(bands: DataFrame, key: list[str] = IMAGE) -> DataFrame:
    """Widths and areas per band, arch index with its class, and the two width ratios, rounded to 4 places."""
    part = lambda b, c: F.when(F.col("band") == b, F.col(c))
    areas = {f"area_{b}": F.coalesce(F.sum(part(b, "area")), F.lit(0)) for b in "ABC"}
    per = bands.groupBy(*key).agg(
        F.max(part("A", "width")).alias("maxA"), F.max(part("C", "width")).alias("maxC"), F.min(part("B", "width")).alias("minB"),
        *[c.alias(k) for k, c in areas.items()], F.sum("area").alias("foot_area"),
    )
    arch = F.try_divide(F.col("area_B").cast("double"), (F.col("area_A") + F.col("area_B") + F.col("area_C")).cast("double"))
    quot = lambda a, b: F.bround(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 4)
    return per.withColumns({
        "arch_class": F.when(arch < 0.21, "high/cavus").when(arch > 0.28, "flat/planus").otherwise("normal"),
        "AI": F.bround(arch, 4), "CSI": quot("minB", "maxA"), "SI": quot("minB", "maxC"),
    })


def threshold_sensitivity(px: DataFrame, fixed: list[int], otsu: DataFrame, key: list[str] = IMAGE) -> DataFrame:
    """Footprint indices at the image's Otsu level and at fixed levels; (image, level) becomes the key."""
    levels = otsu.withColumn("thr", F.explode(F.array_distinct(F.concat(F.array(F.col("otsu").cast("int")), F.array(*map(F.lit, fixed))))))
    wide = [*key, "thr"]
    mask = px.join(levels.select(*wide), key).select(*wide, "row_no", "col_no", (F.col("v") > F.col("thr")).alias("mask"))
    counted = [*wide, "regions"]  # one number per image and level
    return footprint_indices(foot_bands_of_runs(foot_runs(mask, wide, later_wins=False), counted), counted)


def dilation_sweep(mask: DataFrame, percents: list[int], key: list[str] = IMAGE, min_area: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Status per image and kernel size (one column each), and the smallest size that is OK for every image."""
    names = [str(p) for p in percents]

    def count(r: L.Runs):
        """Components of at least the wanted share of the image, per image and kernel; no pixel is copied for a kernel."""
        images, found = len(r.height), {}
        for name, percent in zip(names, percents):
            grown = L.dilated(r, kernel_height(r.height, percent, 3), 5)
            root = L.components(grown, 4)
            size = np.bincount(root, grown.stop - grown.start + 1, len(root))
            big = np.flatnonzero((size > 0) & (size >= (r.height * r.width * min_area)[grown.image]))
            found[name] = np.bincount(grown.image[big], minlength=images)
        return np.arange(images), found

    counts = cut_lineage(of_images(mask, key, count, ", ".join(f"`{n}` int" for n in names)))  # read twice, one row per image
    status = lambda n: F.when(F.col(n) == 2, "OK").when(F.col(n) == 1, "merged").when(F.col(n) == 0, "failed").otherwise(
        F.concat(F.lit(">"), F.col(n).cast("string"), F.lit(" regions"))
    )
    table = counts.select(*key, *[status(n).alias(n) for n in names])
    ok = counts.agg(*[F.bool_and(F.col(n) == 2).alias(n) for n in names])
    return table, ok.select(F.array_min(F.array(*[F.when(F.col(n), F.lit(p)) for n, p in zip(names, percents)])).alias("best_pct"))
