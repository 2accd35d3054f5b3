"""Region, footprint and whole-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from solea.operators import pixels as X
from solea.operators import regions as G
from solea.operators import segmentation as S
from solea.plans.foot_images import prepare_feet
from solea.plans.registry import CHECK_ONCE, EXTRA_CHECK_VIEWS, Inputs, query

RC = "image_id:i row_no:i col_no:i "
_N8 = "abs(p.row_no-f.row_no)<=1 AND abs(p.col_no-f.col_no)<=1"
_N4 = "abs(p.row_no-f.row_no)+abs(p.col_no-f.col_no)<=1"


def _reach_sql(source: str, me: str, near: str) -> str:
    return f"""SELECT image_id, row_no*1048576+col_no AS seed, row_no, col_no FROM {source} UNION
        SELECT p.image_id, f.seed, p.row_no, p.col_no FROM {me} f JOIN {source} p ON p.image_id=f.image_id AND {near}"""


def _otsu_free_bands(source: str) -> str:
    return f"""SELECT image_id, row_no, width, area, CASE WHEN row_no < r0 + len//3 THEN 'C' WHEN row_no < r0 + 2*len//3 THEN 'B' ELSE 'A' END AS band FROM (
        SELECT *, min(row_no) OVER w AS r0, max(row_no) OVER w - min(row_no) OVER w + 1 AS len FROM (
          SELECT image_id, row_no, max(col_no)-min(col_no)+1 AS width, count(*) AS area FROM {source} GROUP BY image_id, row_no) WINDOW w AS (PARTITION BY image_id))"""


EXTRA_CHECK_VIEWS.update({
    "fg_px": "SELECT * FROM pixels WHERE v >= 128",
    "reach8": _reach_sql("fg_px", "reach8", _N8),
    "comp8": "SELECT image_id, row_no, col_no, min(seed) AS comp FROM reach8 GROUP BY ALL",
    "boxes8": """SELECT image_id, comp, count(*) AS size, min(row_no) AS y0, max(row_no)+1 AS y1, min(col_no) AS x0, max(col_no)+1 AS x1 FROM comp8 GROUP BY ALL""",
    "top2": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY size DESC, comp DESC) AS size_rank FROM boxes8) WHERE size_rank <= 2",
    "feet_rows": """SELECT image_id, CASE WHEN row_number() OVER (PARTITION BY image_id ORDER BY x0+x1, comp)=1 THEN 'L' ELSE 'R' END AS foot, x0 AS x_min, y0 AS y_min,
        x1-x0 AS crop_w, y1-y0 AS crop_h, (greatest(x1-x0,y1-y0)-(y1-y0))//2 AS pad_top, (greatest(x1-x0,y1-y0)-(x1-x0))//2 AS pad_left,
        greatest(x1-x0,y1-y0) AS square_size FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS found FROM top2) WHERE found=2""",
    "bg_px": "SELECT * FROM pixels WHERE v < 128",
    "outside": f"""SELECT image_id, row_no, col_no FROM bg_px WHERE row_no IN (0,7) OR col_no IN (0,7) UNION
        SELECT p.image_id, p.row_no, p.col_no FROM outside f JOIN bg_px p ON p.image_id=f.image_id AND {_N4}""",
    "filled_px": "SELECT image_id, row_no, col_no FROM pixels p WHERE NOT EXISTS (SELECT 1 FROM outside o WHERE o.image_id=p.image_id AND o.row_no=p.row_no AND o.col_no=p.col_no)",
    "reach4": _reach_sql("filled_px", "reach4", _N4),
    "comp4": "SELECT image_id, row_no, col_no, min(seed) AS comp FROM reach4 GROUP BY ALL",
    "sizes4": "SELECT image_id, comp, count(*) AS size FROM comp4 GROUP BY ALL",
    "main_px": """SELECT image_id, row_no, col_no FROM comp4 JOIN (SELECT image_id, comp FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY size DESC, comp DESC) AS rn
        FROM sizes4) WHERE rn=1) USING (image_id, comp)""",
    "band_rows": _otsu_free_bands("fg_px"),
})

CHECK_ONCE.update({"fg_px", "bg_px", "filled_px"})


def dense_mask(t: Inputs):
    return t.pixels.withColumn("mask", F.col("v") >= 128).select("image_id", "row_no", "col_no", "v", "mask")


def boxes(t: Inputs):
    return G.component_boxes(G.component_runs(dense_mask(t)))


@query("connected_components", RC + "comp:i", "SELECT * FROM comp8")
def _(t):
    return G.connected_components(dense_mask(t))


@query("two_largest_components", "image_id:i comp:i size:i size_rank:i", "SELECT * FROM top2")
def _(t):
    return G.two_largest(boxes(t))


@query("fill_holes", RC.strip(), "SELECT image_id, row_no, col_no FROM filled_px")
def _(t):
    return G.fill_holes(dense_mask(t)).filter("mask")


@query("dilate_rect", RC + "mask:b",
       """SELECT p.image_id, p.row_no, p.col_no, EXISTS (SELECT 1 FROM fg_px q WHERE q.image_id=p.image_id AND q.v >= 200 AND q.row_no BETWEEN p.row_no-1 AND p.row_no+2
            AND q.col_no BETWEEN p.col_no-2 AND p.col_no+2) AS mask FROM pixels p""")
def _(t):
    return G.dilate_rect(t.pixels.withColumn("mask", F.col("v") >= 200), 4, 5)


_FEET = "image_id:i foot:s x_min:i y_min:i crop_w:i crop_h:i"


@query("split_feet", _FEET + " error:s",
       """SELECT image_id, foot, x_min, y_min, crop_w, crop_h, CAST(NULL AS VARCHAR) AS error FROM feet_rows UNION ALL SELECT DISTINCT image_id, NULL, NULL, NULL, NULL, NULL, 'fewer than 2 regions'
          FROM pixels WHERE image_id NOT IN (SELECT image_id FROM feet_rows)""")
def _(t):
    return G.split_feet(boxes(t), t.pixels)


@query("crop_info", _FEET + " pad_top:i pad_left:i square_size:i", "SELECT * FROM feet_rows")
def _(t):
    return G.split_feet(boxes(t), t.pixels).filter("error IS NULL")


@query("pad_square", RC + "pad_top:i pad_left:i square_size:i",
       "SELECT image_id, row_no + (8-h)//2 AS row_no, col_no, (8-h)//2 AS pad_top, 0 AS pad_left, 8 AS square_size FROM (SELECT *, 3 + image_id % 5 AS h FROM pixels) WHERE row_no < h")
def _(t):
    return G.pad_square(t.pixels.filter("row_no < 3 + image_id % 5"))


@query("toe_removal", "image_id:i regions:i filled_px:i foot_area:i removed_px:i",
       """SELECT image_id, count(*) AS regions, sum(size) AS filled_px, max(size) AS foot_area, sum(size)-max(size) AS removed_px FROM sizes4 GROUP BY image_id""")
def _(t):
    return G.toe_removal(dense_mask(t))[1]


@query("foot_bands", "image_id:i row_no:i band:s width:i area:i", "SELECT * FROM band_rows")
def _(t):
    return G.foot_bands(dense_mask(t))


_IDX = "maxA:i maxC:i minB:i area_A:i area_B:i area_C:i foot_area:i arch_class:s AI:f CSI:f SI:f"
_IDX_SQL = """SELECT *, CASE WHEN a<0.21 THEN 'high/cavus' WHEN a>0.28 THEN 'flat/planus' ELSE 'normal' END AS arch_class, round_even(a,4) AS AI,
  round_even(minB/maxA,4) AS CSI, round_even(minB/maxC,4) AS SI FROM (SELECT *, area_B/(area_A+area_B+area_C) AS a FROM (SELECT image_id,
  max(width) FILTER (band='A') AS maxA, max(width) FILTER (band='C') AS maxC, min(width) FILTER (band='B') AS minB, coalesce(sum(area) FILTER (band='A'),0) AS area_A,
  coalesce(sum(area) FILTER (band='B'),0) AS area_B, coalesce(sum(area) FILTER (band='C'),0) AS area_C, sum(area) AS foot_area FROM {bands} GROUP BY image_id))"""


@query("footprint_indices", "image_id:i " + _IDX, _IDX_SQL.format(bands="band_rows"))
def _(t):
    return G.footprint_indices(G.foot_bands(dense_mask(t)))


def _leveled(text: str) -> str:
    """The single-threshold texts with (image, level) as the key."""
    return text.replace("image_id", "img")


EXTRA_CHECK_VIEWS.update({
    "ts_px": """SELECT image_id*1000 + thr AS img, row_no, col_no, v > thr AS fg FROM pixels JOIN (SELECT image_id, otsu AS thr FROM otsu_rows
        UNION SELECT image_id, unnest([5,10,20,40,60,90,120]) FROM otsu_rows) USING (image_id)""",
    "ts_bg": "SELECT img, row_no, col_no FROM ts_px WHERE NOT fg",
    "ts_out": f"""SELECT img, row_no, col_no FROM ts_bg WHERE row_no IN (0,7) OR col_no IN (0,7) UNION
        SELECT p.img, p.row_no, p.col_no FROM ts_out f JOIN ts_bg p ON p.img=f.img AND {_N4}""",
    "ts_fill": "SELECT img, row_no, col_no FROM ts_px p ANTI JOIN ts_out o USING (img, row_no, col_no)",
    "ts_reach": _leveled(_reach_sql("ts_fill", "ts_reach", _N4)),
    "ts_comp": "SELECT img, row_no, col_no, min(seed) AS comp FROM ts_reach GROUP BY ALL",
    "ts_size": "SELECT img, comp, count(*) AS size FROM ts_comp GROUP BY ALL",
    "ts_main": """SELECT img, row_no, col_no FROM ts_comp JOIN (SELECT img, comp FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY size DESC, comp) AS rn FROM ts_size)
        WHERE rn=1) USING (img, comp)""",
    "ts_bands": _leveled(_otsu_free_bands("ts_main")),
})
CHECK_ONCE.update({"ts_px", "ts_bg", "ts_fill", "ts_comp"})


@query("threshold_sensitivity", "image_id:i thr:i regions:i " + _IDX,
       "SELECT img // 1000 AS image_id, img % 1000 AS thr, * FROM (" + _leveled(_IDX_SQL.format(bands="ts_bands")) + ") JOIN (SELECT img, count(*) AS regions FROM ts_size GROUP BY img) USING (img)")
def _(t):
    return G.threshold_sensitivity(t.pixels, [5, 10, 20, 40, 60, 90, 120], X.otsu_threshold(t.pixels))


_PCTS = [4, 6, 8, 10, 12, 15, 18, 20]


EXTRA_CHECK_VIEWS.update({
    "dl_px": """SELECT p.image_id, p.row_no, p.col_no FROM pixels p WHERE EXISTS (SELECT 1 FROM pixels q WHERE q.image_id=p.image_id AND q.v >= 200
        AND q.row_no BETWEEN p.row_no-1 AND p.row_no+1 AND q.col_no BETWEEN p.col_no-2 AND p.col_no+2)""",
    "dl_reach": _reach_sql("dl_px", "dl_reach", _N4),
    "dl_size": "SELECT image_id, comp, count(*) AS size FROM (SELECT image_id, row_no, col_no, min(seed) AS comp FROM dl_reach GROUP BY ALL) GROUP BY ALL",
    "dl_status": """SELECT image_id, CASE n WHEN 2 THEN 'OK' WHEN 1 THEN 'merged' WHEN 0 THEN 'failed' ELSE '>' || CAST(n AS VARCHAR) || ' regions' END AS s FROM (
        SELECT image_id, count(size) FILTER (size >= 64*0.05) AS n FROM (SELECT DISTINCT image_id FROM pixels) LEFT JOIN dl_size USING (image_id) GROUP BY image_id)""",
})
CHECK_ONCE.add("dl_px")


# an 8-pixel image gives the least kernel height, 3, at every percentage
@query("dilation_sweep", "image_id:i " + " ".join(f"p{p}:s" for p in _PCTS) + " best_pct:i",
       "SELECT image_id, " + ", ".join(f"s AS p{p}" for p in _PCTS) + ", CASE WHEN (SELECT bool_and(s='OK') FROM dl_status) THEN 4 END AS best_pct FROM dl_status")
def _(t):
    table, best = G.dilation_sweep(t.pixels.select("image_id", "row_no", "col_no", (F.col("v") >= 200).alias("mask")), _PCTS)
    named = table.withColumnsRenamed({str(p): f"p{p}" for p in _PCTS})
    return named.withColumn("one", F.lit(1)).join(F.broadcast(best.withColumn("one", F.lit(1))), "one")


@query("gmm_em", "image_id:i k:i weight:f logdet:f iterations:i monotone:b")
def _(t):
    params = S.gmm_em(X.rgb_to_ydbdr(t.rgb_pixels))
    steps = F.zip_with(F.slice("loglik", 1, F.size("loglik") - 1), F.slice("loglik", 2, F.size("loglik")), lambda a, b: b >= a - 1e-3)
    return params.withColumn("iterations", F.size("loglik")).withColumn("monotone", F.forall(steps, lambda x: F.coalesce(x, F.lit(True))))


@query("hmrf_icm", RC + "label:i")
def _(t):
    colour = X.rgb_to_ydbdr(t.rgb_pixels)
    return S.hmrf_icm(S.likelihood_energies(colour, S.gmm_em(colour)))


@query("preprocess_steps", "image_id:i foot:s error:s model_px:i full_px:i original_px:i lo:f hi:f")
def _(t):
    px, feet = prepare_feet(t.rgb_pixels, target=16, tiles=2, least_kernel=1, kernel_width=1)
    kinds = px.groupBy("image_id", "foot").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_px") for k in ("model", "full", "original")],
        F.min(F.when(F.col("kind") == "model", F.col("r"))).alias("lo"), F.max(F.when(F.col("kind") == "model", F.col("r"))).alias("hi"),
    )
    return feet.join(kinds, ["image_id", "foot"], "left")
