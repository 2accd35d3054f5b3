"""Region operators against brute force on small random grids, and edge cases of the image operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from solea.functions import batches as B
from solea.operators import pixels as X
from solea.operators import regions as G
from solea.operators import saliency as C
from solea.operators import segmentation as S
from solea.plans.foot_images import prepare_feet
from solea.sources import images as I

RNG = np.random.default_rng(3)


def to_px(spark, images, name="v"):
    rows = [(i, r, c, int(v)) for i, img in enumerate(images) for r, line in enumerate(img) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, f"image_id bigint, row_no int, col_no int, {name} int")


def masks(spark, images):
    return to_px(spark, images).withColumn("mask", F.col("v") > 0)


def brute_components(img, reach8):
    h, w = img.shape
    comp = -np.ones((h, w), dtype=int)
    for r in range(h):
        for c in range(w):
            if img[r, c] and comp[r, c] < 0:
                todo, comp[r, c] = [(r, c)], r * w + c
                while todo:
                    a, b = todo.pop()
                    for da in (-1, 0, 1):
                        for db in (-1, 0, 1):
                            if (da or db) and (reach8 or not (da and db)):
                                x, y = a + da, b + db
                                if 0 <= x < h and 0 <= y < w and img[x, y] and comp[x, y] < 0:
                                    comp[x, y] = comp[r, c]
                                    todo.append((x, y))
    return comp


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_match_flood_fill(spark, connectivity):
    images = [RNG.random((9, 13)) < d for d in (0.35, 0.5, 0.65)] + [np.tile([[1, 1, 1, 1, 1, 1], [0, 0, 0, 0, 0, 1], [1, 1, 1, 1, 1, 1], [1, 0, 0, 0, 0, 0]], (3, 1))]
    got = G.connected_components(masks(spark, images), connectivity).collect()
    for i, img in enumerate(images):
        want = brute_components(np.asarray(img), connectivity == 8)
        have = {(r.row_no, r.col_no): divmod(r.comp, 1 << 20) for r in got if r.image_id == i}
        assert len(have) == np.asarray(img).sum()
        assert all(want[p] == q[0] * img.shape[1] + q[1] for p, q in have.items())


def test_holes_fill_inside_only(spark):
    ring = np.array([[1, 1, 1, 1], [1, 0, 0, 1], [1, 1, 1, 1], [0, 0, 1, 0]])
    open_ = np.array([[1, 1, 1, 1], [1, 0, 0, 0], [1, 1, 1, 1], [0, 0, 0, 0]])
    got = G.fill_holes(masks(spark, [ring, open_])).filter("mask").groupBy("image_id").count().orderBy("image_id").collect()
    assert [r["count"] for r in got] == [ring.sum() + 2, open_.sum()]


@pytest.mark.parametrize("height,rows", [(3, [4, 5, 6]), (4, [3, 4, 5, 6]), (10, list(range(0, 10)))])
def test_dilation_even_side_reaches_ahead(spark, height, rows):
    img = np.zeros((12, 7), dtype=int)
    img[5, 3] = 1
    got = G.dilate_rect(masks(spark, [img]), height, 5).filter("mask").collect()
    assert sorted({r.col_no for r in got}) == [1, 2, 3, 4, 5]
    assert sorted({r.row_no for r in got}) == rows


def test_touching_feet_fail_and_two_feet_are_ordered(spark):
    one, two = np.ones((4, 6), dtype=int), np.zeros((4, 6), dtype=int)
    two[0:3, 4:6], two[1:4, 0:2] = 1, 1
    m = masks(spark, [one, two])
    feet = G.split_feet(G.component_boxes(G.component_runs(m)), m).orderBy("image_id", "foot").collect()
    assert feet[0].error and feet[0].foot is None
    assert [(f.foot, f.x_min, f.y_min, f.square_size) for f in feet[1:]] == [("L", 0, 1, 3), ("R", 4, 0, 3)]


def test_flat_and_black_images(spark):
    px = to_px(spark, [np.full((3, 3), 7), np.zeros((3, 3), dtype=int)])
    assert {r.scaled for r in X.minmax_norm(px).collect()} == {0.0}
    weights = spark.createDataFrame([(0, 70.0), (1, 70.0)], "image_id bigint, weight_kg double")
    errors = {r.image_id: r.error for r in X.pressure_map(px, weights)[1].collect()}
    assert errors[0] is None and errors[1]
    assert {r.image_id: r.entropy for r in X.foot_entropy(px, F.col("v") > 0).collect()} == {0: 0.0, 1: 0.0}


def test_resize_keeps_constants_and_averages(spark):
    px = to_px(spark, [np.full((6, 6), 9), np.tile([0, 100], (4, 2))])
    out = X.resize_bilinear(px, 3).collect()
    assert {r.v for r in out if r.image_id == 0} == {9} and len(out) == 18


def test_clahe_of_odd_sizes_stays_in_range(spark):
    px = to_px(spark, [RNG.integers(0, 256, (11, 13))])
    out = X.clahe(px, 3.5, 4)
    row = out.agg(F.count("v"), F.min("v"), F.max("v")).first()
    assert row[0] == 143 and 0 <= row[1] <= row[2] <= 255


def test_mixture_likelihood_never_falls(spark):
    img = np.concatenate([RNG.normal(60, 5, 40), RNG.normal(150, 8, 40), RNG.normal(220, 4, 41)]).clip(0, 255).astype(int).reshape(11, 11)
    px = to_px(spark, [img], "r").withColumns({"g": F.col("r") + 3 * F.col("row_no"), "b": F.col("r") - 2 * F.col("col_no")})
    params = S.gmm_em(X.rgb_to_ydbdr(px)).collect()
    history = np.array(params[0].loglik)
    assert len(params) == 3 and (np.diff(history) > -1e-6 * abs(history[0])).all()
    assert sum(p.weight for p in params) == pytest.approx(1.0)


def test_segmentation_finds_the_bright_block(spark):
    img = RNG.integers(8, 14, (12, 12))
    img[3:9, 2:10] = RNG.integers(180, 200, (6, 8))
    px = to_px(spark, [img], "r").withColumns({"g": F.col("r"), "b": (F.col("r") / 2).cast("int")})
    mask = {(r.row_no, r.col_no) for r in S.segment_foot(px).filter("mask").collect()}
    inside = {(r, c) for r in range(3, 9) for c in range(2, 10)}
    assert mask <= inside and len(mask) >= 0.4 * len(inside)


def brute_fill(img):
    wall = np.pad(img, 1)
    comp = brute_components(~wall, False)
    return ~((comp == comp[0, 0]) & ~wall)[1:-1, 1:-1]


def brute_foot(img, later):
    whole = brute_fill(img)
    comp = brute_components(whole, False)
    sizes = {c: (comp == c).sum() for c in np.unique(comp[comp >= 0])}
    if not sizes:
        return whole, img, 0
    best = max(sizes, key=lambda c: (sizes[c], c if later else -c))
    return whole, brute_fill(comp == best), len(sizes)


@pytest.mark.parametrize("later", [True, False])
def test_feet_of_many_sizes_match_brute_force(spark, monkeypatch, later):
    monkeypatch.setattr(B.whole_groups, "__defaults__", (40,))  # frames of a few images each
    images = [RNG.random((int(RNG.integers(1, 12)), int(RNG.integers(1, 12)))) < d for d in (0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9) for _ in range(4)] + [np.zeros((3, 4), bool), np.ones((5, 2), bool)]
    m = masks(spark, images)
    foot, counts = G.toe_removal(m, later_wins=later)
    pixels = {(r.image_id, r.row_no, r.col_no): r.mask for r in foot.collect()}
    filled = {(r.image_id, r.row_no, r.col_no): r.mask for r in G.fill_holes(m).collect()}
    counts = {r.image_id: (r.regions, r.filled_px, r.foot_area, r.removed_px) for r in counts.collect()}
    for i, img in enumerate(images):
        whole, kept, regions = brute_foot(img, later)
        assert all(pixels[i, r, c] == kept[r, c] and filled[i, r, c] == whole[r, c] for r in range(img.shape[0]) for c in range(img.shape[1]))
        assert counts.get(i) == ((regions, whole.sum(), kept.sum(), (whole & ~kept).sum()) if regions else None)
    assert len(pixels) == sum(img.size for img in images)


def test_regions_need_one_shuffle_and_no_stored_rounds(spark):
    m = masks(spark, [np.ones((2, 2), int)])
    for df in (G.connected_components(m), G.fill_holes(m), *G.toe_removal(m)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "parquet" not in plan


def test_smoothing_equals_repeated_sweeps(spark):
    images = [RNG.integers(0, 256, shape) for shape in ((6, 9), (1, 7), (5, 1), (12, 12), (1, 1))]
    px = to_px(spark, images).withColumn("label", F.pmod(F.col("v"), F.lit(3)))
    px = px.withColumns({f"e{k}": F.abs(F.col("v") - mu) / 40.0 for k, mu in enumerate((60, 128, 196))})
    for sweeps in (1, 3):
        step = px
        for _ in range(sweeps):
            step = X.icm_sweep(step, 3).withColumn("label", F.col("new_label")).drop("new_label")
        at = lambda df: {(r.image_id, r.row_no, r.col_no): r.label for r in df.collect()}
        assert at(S.hmrf_icm(px, max_sweeps=sweeps, tol=0.0)) == at(step)


def test_frames_end_where_groups_end():
    rows = pd.DataFrame({"k": [None, None, 1, 1, 1, 1, 1, 1, 2, 3, 3], "v": range(11)}).astype({"k": "Int64"})
    for size in (1, 2, 3, 50):
        for limit in (1, 3, 100):
            frames = list(B.whole_groups((rows.iloc[i : i + size] for i in range(0, 11, size)), ["k"], limit))
            assert pd.concat(frames).v.tolist() == list(range(11))
            assert sum(f.k.nunique(dropna=False) for f in frames) == 4
    assert list(B.whole_groups(iter([]), ["k"])) == []


def test_faulty_images_have_one_error_each(spark):
    whole = [(r, c, 10 * r + c) for r in range(3) for c in range(4)]
    spoilt = {
        0: whole, 1: whole[:-2] + whole[-1:], 2: [*whole, whole[5]], 3: [*whole[1:], (0, 0, 256)], 4: [*whole[1:], (0, 0, None)],
        5: [*whole[1:], (0, -1, 3)], 6: [*whole, (None, 1, 3)], None: whole, 7: [*whole[1:], (0, 0, float("nan"))], 8: [(0, 0, 5)],
    }
    rows = [(i, r, c, None if v is None else float(v), "mine") for i, px in spoilt.items() for r, c, v in px]
    px = spark.createDataFrame(rows, "image_id bigint, row_no int, col_no int, v double, error string")
    good, faulty = I.quarantine(px, ["v"], ["image_id"])
    assert {r.image_id: r.error for r in faulty.collect()} == {
        1: "pixels missing", 2: "place given twice", 3: "value outside 0 to 255", 4: "value outside 0 to 255", 5: "pixel without a place",
        6: "pixel without a place", None: "image without a name", 7: "value outside 0 to 255"}
    assert good.columns == px.columns and {r.image_id: r["count"] for r in good.groupBy("image_id").count().collect()} == {0: 12, 8: 1}
    none = I.quarantine(px.where("false"), ["v"], ["image_id"])
    assert none[0].count() == none[1].count() == 0


def soles(rng, height=100, width=140):
    """A bright, coloured pair of soles of unlike size on dark ground."""
    row, col = np.mgrid[0:height, 0:width]
    lit = sum(((row - height * 0.5) / (height * 0.38)) ** 2 + ((col - width * at) / (width * wide)) ** 2 < 1 for at, wide in ((0.26, 0.13), (0.74, 0.15))) > 0
    ground = rng.integers(4, 16, (height, width, 3))
    return np.where(lit[..., None], np.array([210, 170, 120]) + rng.integers(-12, 13, (height, width, 3)), ground)


def test_full_size_preparation_goes_on_past_a_corrupt_image(spark):
    rng = np.random.default_rng(21)
    images = [soles(rng) for _ in range(3)]
    rows = pd.concat([pd.DataFrame({"image_id": i, "row_no": np.repeat(np.arange(100), 140), "col_no": np.tile(np.arange(140), 100),
                                    **{c: img[..., k].ravel() for k, c in enumerate("rgb")}}) for i, img in enumerate(images)])
    cut = rows[(rows.image_id != 1) | (rows.row_no * 140 + rows.col_no != 777)]
    px, feet = prepare_feet(spark.createDataFrame(cut, "image_id bigint, row_no int, col_no int, r int, g int, b int"))
    status = {(r.image_id, r.foot): r for r in feet.collect()}
    assert set(status) == {(0, "L"), (0, "R"), (1, None), (2, "L"), (2, "R")} and status[1, None].error == "pixels missing"
    assert all(r.error is None and abs(r.crop_h - 76) <= 16 for k, r in status.items() if k[0] != 1)
    counts = {(r.image_id, r.foot, r.kind): r for r in px.groupBy("image_id", "foot", "kind").agg(
        F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}
    for at in status:
        if at[0] != 1:
            side = status[at].square_size
            assert counts[*at, "model"].n == 224 * 224 and 0 <= counts[*at, "model"].lo <= counts[*at, "model"].hi <= 1
            assert counts[*at, "full"].n == counts[*at, "original"].n == side * side and counts[*at, "original"].hi <= 222
    assert len(counts) == 12


def test_files_that_are_no_images(spark, tmp_path):
    import struct
    import zlib

    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + bytes([10 * r + c, 100, 200]) for r in range(2) for c in range(1))
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 2, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")
    (tmp_path / "good.png").write_bytes(png)
    (tmp_path / "bad.png").write_bytes(png[:40])
    found = I.decode_images(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r.row_no, r.col_no, r.r, r.g, r.b) for r in found] == [(0, 0, 0, 100, 200), (1, 0, 10, 100, 200)]
    bad = I.undecodable_images(spark, str(tmp_path)).collect()
    assert [r.image_id.rsplit("/", 1)[1] for r in bad] == ["bad.png"] and bad[0].error == "not an image"


def plain_clahe(img, clip, tiles):
    size = len(img) // tiles
    luts = np.empty((tiles, tiles, 256))
    for y in range(tiles):
        for x in range(tiles):
            counts = np.bincount(img[y * size : (y + 1) * size, x * size : (x + 1) * size].ravel(), minlength=256)
            cap = max(int(clip * size * size / 256), 1)
            excess = np.maximum(counts - cap, 0).sum()
            counts = np.minimum(counts, cap) + excess // 256
            rest = excess % 256
            if rest:
                counts[np.arange(rest) * max(256 // rest, 1)] += 1
            luts[y, x] = np.minimum(np.rint(counts.cumsum() * (255.0 / size**2)), 255)
    out = np.empty_like(img)
    for (r, c), v in np.ndenumerate(img):
        fy, fx = r / size - 0.5, c / size - 0.5
        ya, xa = fy - np.floor(fy), fx - np.floor(fx)
        y1, y2, x1, x2 = max(int(np.floor(fy)), 0), min(int(np.floor(fy)) + 1, tiles - 1), max(int(np.floor(fx)), 0), min(int(np.floor(fx)) + 1, tiles - 1)
        out[r, c] = np.rint((luts[y1, x1, v] * (1 - xa) + luts[y1, x2, v] * xa) * (1 - ya) + (luts[y2, x1, v] * (1 - xa) + luts[y2, x2, v] * xa) * ya)
    return out


def test_clip_limits_against_plain_loops(spark):
    row, col = np.mgrid[0:32, 0:32]
    images = [(40 + 3 * col + RNG.integers(0, 9, (32, 32))) % 256, np.where((row - 16) ** 2 + (col - 16) ** 2 < 150, 180 + RNG.integers(0, 30, (32, 32)), 0), RNG.integers(0, 256, (32, 32))]
    taps = np.exp(-0.5 * (np.arange(-12, 13) / 3.0) ** 2)
    taps /= taps.sum()
    found = {r.image_id: r for r in X.clahe_selection(to_px(spark, images), tiles=2).collect()}
    for i, img in enumerate(images):
        entropies, noises = [], []
        for clip in X.CLIP_LIMITS:
            out = plain_clahe(img, clip, 2)
            share = np.unique(out[img > 0], return_counts=True)[1] / (img > 0).sum()
            entropies.append(-(share * np.log2(share)).sum())
            blur = out.astype(float)
            for axis in (0, 1):
                blur = np.apply_along_axis(lambda line: np.convolve(np.pad(line, 12, "symmetric"), taps, "valid"), axis, blur)
            noises.append(np.abs(out - blur).mean())
        limit = np.mean(noises) + np.std(noises)
        want = [c for c, e, n in zip(X.CLIP_LIMITS, entropies, noises) if e >= 0.99 * max(entropies) and n <= limit]
        assert found[i].max_entropy == pytest.approx(max(entropies), abs=1e-9) and found[i].clip == (min(want) if want else None)
    assert len(set(np.round(entropies, 6))) > 3  # the limits differ


def test_limits_with_the_same_cap_are_worked_out_once(spark, monkeypatch):
    asked, real = [], X.clahe
    monkeypatch.setattr(X, "clahe", lambda df, *rest: asked.append({(r.image_id, r.clip) for r in df.select("image_id", "clip").distinct().collect()}) or real(df, *rest))
    images = [RNG.integers(0, 4, (32, 32)) * 60, RNG.integers(0, 4, (8, 8)) * 60]  # tiles of 256 and of 16 pixels
    assert X.clahe_selection(to_px(spark, images), tiles=2).count() == 2
    assert asked == [{(0, c) for c in (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)} | {(1, 1.0)}]


def test_blur_runs_on_whole_lines_outside_the_row_interpreter(spark):
    px = to_px(spark, [RNG.integers(0, 256, (5, 9)), RNG.integers(0, 256, (1, 3))]).withColumn("v", F.when(~F.expr("image_id = 1 AND col_no = 1"), F.col("v")))
    blurred = X.gaussian_blur(px, sigma=0.1)  # a single tap: values stay
    assert "ArrowEvalPython" in blurred._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(df.select("image_id", "row_no", "col_no", F.col("v").cast("double")).collect(), key=str)
    assert rows(blurred) == rows(px)


def test_frames_do_not_grow_with_the_partition():
    px = pd.DataFrame({"k": np.arange(600_000) // 64, "v": np.uint8(0)})
    frames = [len(f) for f in B.whole_groups((px.iloc[i : i + 10_000] for i in range(0, len(px), 10_000)), ["k"])]
    assert sum(frames) == len(px) and max(frames) <= 120_000


def test_eigen_maps_of_many_images_and_shapes_need_no_group_each(spark):
    stacks = [RNG.normal(size=(k, h, w)) for k, h, w in ((4, 2, 3), (2, 3, 2), (4, 3, 2), (4, 2, 3), (1, 1, 4))]
    rows = [(i, c, h, w, float(v)) for i, stack in enumerate(stacks) for (c, h, w), v in np.ndenumerate(stack)]
    found = C.eigen_cam(spark.createDataFrame(rows, "image_id bigint, ch int, h int, w int, act double").repartition(3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    got = {(r.image_id, r.h, r.w): r.cam for r in found.collect()}
    assert len(got) == sum(stack[0].size for stack in stacks)
    for i, stack in enumerate(stacks):
        flat = stack.reshape(len(stack), -1)
        u = np.linalg.svd((flat - flat.mean(axis=1, keepdims=True)).T, full_matrices=False)[0][:, 0]
        u = u * (1.0 if u[np.argmax(np.abs(u).round(12))] >= 0 else -1.0)
        u = u - u.min()
        assert [got[i, h, w] for h, w in np.ndindex(stack.shape[1:])] == pytest.approx(u / (u.max() + 1e-8))


def test_dilation_sweep_of_uneven_images_copies_no_pixel_for_a_kernel(spark, monkeypatch):
    rng = np.random.default_rng(8)
    images = [(rng.random((h, w)) < share).astype(int) for h, w, share in ((40, 33, 0.01), (67, 30, 0.02), (25, 51, 0.004), (9, 9, 0.0), (1, 1, 1.0))]
    plans = []
    monkeypatch.setattr(G, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().toString()) or df)
    percents = [4, 12, 30]
    table, best = G.dilation_sweep(masks(spark, images), percents)
    assert plans and not any("explode" in plan for plan in plans)
    got = {r.image_id: [r[str(p)] for p in percents] for r in table.collect()}
    for i, img in enumerate(images):
        for p, status in zip(percents, got[i]):
            h, grown = max(3, img.shape[0] * p // 100), np.zeros_like(img)
            for y, x in zip(*np.nonzero(img)):
                grown[max(y - h // 2, 0) : y + (h - 1) // 2 + 1, max(x - 2, 0) : x + 3] = 1
            whole = G.dilate_rect(masks(spark, [img]), h, 5) if i == 1 else None
            if whole is not None:
                assert {(r.row_no, r.col_no) for r in whole.filter("mask").collect()} == set(zip(*map(list, np.nonzero(grown))))
            seen, n = np.zeros_like(grown), 0
            for start in zip(*np.nonzero(grown)):
                stack, size = [start], 0
                while stack:
                    y, x = stack.pop()
                    if 0 <= y < img.shape[0] and 0 <= x < img.shape[1] and grown[y, x] and not seen[y, x]:
                        seen[y, x], size = 1, size + 1
                        stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
                n += size > 0 and size >= img.size * 0.05
            assert status == {0: "failed", 1: "merged", 2: "OK"}.get(n, f">{n} regions")
    assert best.first().best_pct is None
    assert G.dilation_sweep(masks(spark, [np.eye(1, 40, dtype=int) + np.eye(1, 40, 30, dtype=int)]), [50, 4])[1].first().best_pct == 4


def test_resizing_uneven_images_takes_one_shuffle(spark):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, size) for size in ((3, 7), (7, 3), (12, 12), (1, 5), (3, 7))]
    rows = [(i, y, x, int(v)) for i, img in enumerate(images) for (y, x), v in np.ndenumerate(img)]
    rows[4] = (*rows[4][:3], None)
    out = X.resize_bilinear(spark.createDataFrame(rows, "image_id int, row_no int, col_no int, v int"), 5)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.image_id, r.row_no, r.col_no): r.v for r in out.collect()}
    assert len(got) == 5 * 25

    def line(values):
        scale, made = len(values) / 5, []
        support = max(scale, 1.0)
        for o in range(5):
            centre = (o + 0.5) * scale
            taps = [(max(0.0, 1 - abs((j - centre + 0.5) / support)), values[j]) for j in range(max(int(centre - support + 0.5), 0), min(int(centre + support + 0.5), len(values)))]
            made.append(int(sum(w * v for w, v in taps) / sum(w for w, _ in taps) + 0.5 + 1e-9))
        return made

    for i, img in enumerate(images[1:], 1):
        want = np.array([line(c) for c in np.array([line(r) for r in img]).T]).T
        assert all(got[i, y, x] == v for (y, x), v in np.ndenumerate(want))
    assert any(got[0, y, x] is None for y in range(5) for x in range(5)) and got[0, 4, 0] is not None


def test_settled_mixtures_rest_while_others_go_on(monkeypatch):
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=(30, 3)) * 0.01 + np.repeat(np.eye(3) * 5, 10, 0), rng.normal(size=(200, 3))]
    first, picked = np.array([0, 30]), np.array([[0, 10, 20], [30, 31, 32]])
    joint, worked = S._joint, []
    monkeypatch.setattr(S, "_joint", lambda x, *more: worked.append(len(x)) or joint(x, *more))
    together = S._fit_mixtures(np.concatenate(parts), np.ones(230), first, picked, 80, 1e-4)
    alone = [S._fit_mixtures(x, np.ones(len(x)), np.array([0]), p[None] - f, 80, 1e-4) for x, p, f in zip(parts, picked, first)]
    assert worked[0] == 230 and 200 in worked
    for i in range(2):
        assert all(np.allclose(a[i], b[0]) for a, b in zip(together[:3], alone[i][:3])) and np.allclose(together[3][i], alone[i][3][0])
