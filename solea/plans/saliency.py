"""Saliency and annotation-box queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from solea.operators import boxes as B
from solea.operators import saliency as S
from solea.operators.case_tables import roi_summary
from solea.plans.registry import CHECK_ONCE, EXTRA_CHECK_VIEWS, Inputs, query

HW = "image_id:i h:i w:i cam:f"


def _cam(weight: str) -> str:
    return f"""SELECT image_id, h, w, greatest(s,0)/(max(greatest(s,0)) OVER (PARTITION BY image_id)+1e-8) AS cam FROM (
        SELECT m.image_id, h, w, sum(act*weight) AS s FROM grad_maps m JOIN ({weight}) k USING (image_id, ch) GROUP BY m.image_id, h, w)"""


def _up(cam: str) -> str:
    """Bilinear 4x4 to 8x8 with half-pixel centres."""
    axis = "SELECT o, greatest(floor((o+0.5E0)/2-0.5E0),0) AS lo, least(floor((o+0.5E0)/2-0.5E0)+1,3) AS hi, (o+0.5E0)/2-0.5E0-floor((o+0.5E0)/2-0.5E0) AS f FROM (SELECT unnest(range(8)) AS o)"
    return f"""WITH ax AS ({axis}), hz AS (SELECT a.image_id, a.h, ax.o AS col_no, a.cam+(b.cam-a.cam)*f AS cam FROM {cam} a, ax JOIN {cam} b ON b.image_id=a.image_id AND b.h=a.h AND b.w=ax.hi WHERE a.w=ax.lo)
        SELECT a.image_id, ax.o AS row_no, a.col_no, a.cam+(b.cam-a.cam)*f AS cam FROM hz a, ax JOIN hz b ON b.image_id=a.image_id AND b.col_no=a.col_no AND b.h=ax.hi WHERE a.h=ax.lo"""


def _high(up: str) -> str:
    return f"""SELECT u.image_id, row_no, col_no, cam FROM {up} u JOIN (SELECT image_id, quantile_cont(round(cam,9), 0.95) AS cut FROM {up} GROUP BY image_id) USING (image_id) WHERE round(cam,9) >= cut"""


def _hits(method: str, high: str) -> str:
    return f"""SELECT '{method}' AS method, b.box_id, CASE WHEN EXISTS (SELECT 1 FROM {high} p WHERE p.image_id=b.image_id AND p.row_no BETWEEN by1 AND by2 AND p.col_no BETWEEN bx1 AND bx2)
        THEN 1 ELSE 0 END AS hit FROM grown_boxes b WHERE b.image_id IN (SELECT image_id FROM {high})"""


# The leading singular vector without a solver: the channels' Gram matrix squared again and again, scaled by its trace, tends to a multiple of v v'.
_SQUARINGS = 20
EXTRA_CHECK_VIEWS.update({
    "act_centred": "SELECT image_id, ch, h, w, act - avg(act) OVER (PARTITION BY image_id, ch) AS a FROM activations",
    "gram_0": "SELECT x.image_id, x.ch AS i, y.ch AS j, sum(x.a*y.a) AS g FROM act_centred x JOIN act_centred y USING (image_id, h, w) GROUP BY 1, 2, 3",
    **{f"gram_{n + 1}": f"""SELECT x.image_id, x.i, y.j, sum(x.g*y.g)/any_value(t.t*t.t) AS g FROM gram_{n} x JOIN gram_{n} y ON x.image_id=y.image_id AND x.j=y.i
        JOIN (SELECT image_id, sum(g) FILTER (i=j) AS t FROM gram_{n} GROUP BY image_id) t ON t.image_id=x.image_id GROUP BY x.image_id, x.i, y.j""" for n in range(_SQUARINGS)},
    "eigen_raw": f"""SELECT image_id, h, w, sum(a*g) AS u FROM act_centred JOIN gram_{_SQUARINGS} USING (image_id) JOIN (
        SELECT image_id, arg_max(i, g) AS best FROM gram_{_SQUARINGS} WHERE i=j GROUP BY image_id) USING (image_id) WHERE ch=i AND j=best GROUP BY image_id, h, w""",
    "eigen_unit": "SELECT image_id, h, w, u/sqrt(sum(u*u) OVER (PARTITION BY image_id)) AS u FROM eigen_raw",
    "eigen_signed": """SELECT e.image_id, h, w, CASE WHEN s >= 0 THEN u ELSE -u END AS u FROM eigen_unit e JOIN (
        SELECT image_id, arg_max(u, round(abs(u), 12)) AS s FROM eigen_unit GROUP BY image_id) USING (image_id)""",
    "eigen_rows": """SELECT image_id, h, w, (u - min(u) OVER (PARTITION BY image_id))/(max(u) OVER (PARTITION BY image_id) - min(u) OVER (PARTITION BY image_id) + 1e-8) AS cam FROM eigen_signed""",
})
CHECK_ONCE.update({"act_centred", "eigen_raw", "eigen_unit", "eigen_signed", "eigen_rows", *(f"gram_{n}" for n in range(_SQUARINGS + 1))})

EXTRA_CHECK_VIEWS.update({
    "grad_maps": "SELECT a.*, b.act AS grad FROM activations a JOIN activations b ON b.image_id=a.image_id+1 AND b.ch=a.ch AND b.h=a.h AND b.w=a.w",
    "cam_rows": _cam("SELECT image_id, ch, avg(grad) AS weight FROM grad_maps GROUP BY ALL"),
    "campp_rows": _cam("""SELECT image_id, ch, sum(grad*grad/CASE WHEN abs(2*grad*grad+total*grad*grad*grad)>1e-8 THEN 2*grad*grad+total*grad*grad*grad ELSE 1e-8 END*greatest(grad,0)) AS weight
        FROM (SELECT *, sum(act) OVER (PARTITION BY image_id, ch) AS total FROM grad_maps) GROUP BY ALL"""),
    "cam_up": _up("cam_rows"), "campp_up": _up("campp_rows"), "cam_high": _high("cam_up"), "campp_high": _high("campp_up"),
    "eigen_up": _up("eigen_rows"), "eigen_high": _high("eigen_up"),
    "grown_boxes": """SELECT *, greatest(0, CAST(trunc(x*8/orig_w) AS INT)-1) AS bx1, greatest(0, CAST(trunc(y*8/orig_h) AS INT)-1) AS by1,
        least(7, CAST(trunc((x+w)*8/orig_w) AS INT)+1) AS bx2, least(7, CAST(trunc((y+h)*8/orig_h) AS INT)+1) AS by2 FROM boxes""",
    "hit_rows": _hits("GradCAM", "cam_high") + " UNION ALL " + _hits("GradCAM++", "campp_high") + " UNION ALL " + _hits("EigenCAM", "eigen_high"),
})
CHECK_ONCE.update({"cam_rows", "campp_rows", "cam_up", "campp_up", "cam_high", "campp_high", "eigen_up", "eigen_high"})


def maps(t: Inputs):
    a = t.activations
    grads = a.select((F.col("image_id") - 1).alias("image_id"), "ch", "h", "w", F.col("act").alias("grad"))
    return a.join(grads, ["image_id", "ch", "h", "w"])


def grown(t: Inputs):
    return B.scale_expand(t.boxes, 8, 1)


@query("grad_cam", HW, "SELECT * FROM cam_rows")
def _(t):
    return S.grad_cam(maps(t))


@query("grad_cam_pp", HW, "SELECT * FROM campp_rows")
def _(t):
    return S.grad_cam_pp(maps(t))


@query("eigen_cam", HW, "SELECT * FROM eigen_rows")
def _(t):
    return S.eigen_cam(t.activations)


@query("upsample_map", "image_id:i row_no:i col_no:i cam:f", "SELECT * FROM cam_up")
def _(t):
    return S.upsample_map(S.grad_cam(maps(t)), 8)


@query("high_activation", "image_id:i row_no:i col_no:i", "SELECT * FROM cam_high")
def _(t):
    return S.high_activation(S.upsample_map(S.grad_cam(maps(t)), 8))


def hits(t: Inputs):
    m = maps(t)
    return S.pointing_game({"GradCAM": S.grad_cam(m), "GradCAM++": S.grad_cam_pp(m), "EigenCAM": S.eigen_cam(t.activations)}, grown(t), 8)


@query("pointing_game", "method:s box_id:i hit:i", "SELECT * FROM hit_rows")
def _(t):
    return hits(t)


@query("hit_rate", "method:s rate:f hits:i n:i", "SELECT method, avg(hit) AS rate, sum(hit) AS hits, count(*) AS n FROM hit_rows GROUP BY method")
def _(t):
    return S.hit_rate(hits(t))


@query("points_in_box", "box_id:i inside:i",
       """SELECT box_id, count(*) AS inside FROM grown_boxes b JOIN pixels p ON p.image_id=b.image_id AND p.v>=160 AND row_no BETWEEN by1 AND by2 AND col_no BETWEEN bx1 AND bx2 GROUP BY box_id""")
def _(t):
    pts = t.pixels.filter("v >= 160").select("image_id", "row_no", "col_no")
    return B.points_in_box(pts, grown(t).select("box_id", "image_id", "bx1", "by1", "bx2", "by2")).groupBy("box_id").agg(F.count(F.lit(1)).alias("inside"))


@query("annotation_join", "image_id:i box_id:i y:i", "SELECT e.vec_id AS image_id, box_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings e JOIN boxes b ON b.image_id=e.vec_id WHERE vec_id % 5 = 0")
def _(t):
    name = lambda c: F.concat(F.lit("img"), F.col(c), F.lit(".npy")).alias("filename")
    test = t.table("embeddings").filter("vec_id % 5 = 0").select(name("vec_id"), F.col("vec_id").alias("image_id"), (F.col("label") >= 5).cast("int").alias("y"))
    return B.annotation_join(test, t.boxes.select(name("image_id"), "box_id"))


_SC = "224.0E0/square_size"
_MODEL = f"""SELECT box_id, foot, round_even((x-x_min+pad_left)*({_SC}),0) AS mx, round_even((y-y_min+pad_top)*({_SC}),0) AS my, round_even(w*({_SC}),0) AS mw, round_even(h*({_SC}),0) AS mh FROM boxes"""


@query("roi_to_model", "box_id:i mx:i my:i mw:i mh:i", _MODEL)
def _(t):
    return B.roi_to_model(t.boxes)


@query("roi_mirror", "box_id:i mx:i my:i mw:i mh:i", f"SELECT box_id, 224-mx-mw AS mx, my, mw, mh FROM ({_MODEL}) WHERE foot='L'")
def _(t):
    return B.roi_mirror(B.roi_to_model(t.boxes.filter("foot = 'L'")))


@query("bbox_scale_expand", "box_id:i bx1:i by1:i bx2:i by2:i",
       """SELECT box_id, greatest(0, CAST(trunc(x*224/orig_w) AS INT)-15) AS bx1, greatest(0, CAST(trunc(y*224/orig_h) AS INT)-15) AS by1,
            least(223, CAST(trunc((x+w)*224/orig_w) AS INT)+15) AS bx2, least(223, CAST(trunc((y+h)*224/orig_h) AS INT)+15) AS by2 FROM boxes""")
def _(t):
    return B.scale_expand(t.boxes)


@query("roi_summary", "image_id:i foot:s region_count:i has_risk_area:s",
       """SELECT image_id, foot, n AS region_count, CASE image_id % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' ELSE CASE WHEN n>0 THEN 'yes' ELSE '' END END AS has_risk_area
          FROM (SELECT image_id, foot, count(*) FILTER (w > 30) AS n FROM boxes GROUP BY image_id, foot)""")
def _(t):
    sides = t.boxes.groupBy("image_id", "foot").agg(F.count_if(F.col("w") > 30).alias("region_count"))
    answer = F.expr("CASE image_id % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN '' END")
    return roi_summary(sides.withColumn("has_risk_area", answer))
