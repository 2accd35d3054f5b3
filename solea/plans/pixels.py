"""Colour, contrast and statistics queries on the pixel views."""

from __future__ import annotations

from pyspark.sql import functions as F

from solea.operators import pixels as X
from solea.operators.segmentation import hmrf_icm
from solea.plans.registry import CHECK_ONCE, EXTRA_CHECK_VIEWS, Inputs, query

RC = "image_id:i row_no:i col_no:i "
_YDD = "0.299*r+0.587*g+0.114*b AS Y, -0.450*r-0.883*g+1.333*b AS Db, -1.333*r+1.116*g+0.217*b AS Dr"
EXTRA_CHECK_VIEWS.update({
    "labelled_px": "SELECT *, v // 86 AS label FROM pixels",
    "px_cdf": """SELECT image_id, v, n, sum(n) OVER w AS cum_n, sum(n*v) OVER w AS cum_mass FROM (SELECT image_id, v, count(*) AS n FROM pixels GROUP BY image_id, v)
        WINDOW w AS (PARTITION BY image_id ORDER BY v)""",
    "nb_counts": """SELECT p.image_id, p.row_no, p.col_no, p.v, p.label, count(*) FILTER (q.label=0) AS nb0, count(*) FILTER (q.label=1) AS nb1, count(*) FILTER (q.label=2) AS nb2
        FROM labelled_px p JOIN labelled_px q ON p.image_id=q.image_id AND abs(p.row_no-q.row_no)+abs(p.col_no-q.col_no)=1 GROUP BY ALL""",
    "otsu_rows": """SELECT image_id, v AS otsu FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(bt,9) DESC, v) AS rn FROM (
        SELECT *, pow(mass*cum_n/tot - cum_mass, 2) / nullif(cum_n*(tot-cum_n),0) AS bt FROM (
          SELECT *, max(cum_n) OVER (PARTITION BY image_id) AS tot, max(cum_mass) OVER (PARTITION BY image_id) AS mass FROM px_cdf)) WHERE bt IS NOT NULL) WHERE rn=1""",
})


@query("parse_stem", "image_id:i subject:s sex:s foot:s",
       "SELECT DISTINCT image_id, 'S' || CAST(subject AS VARCHAR) AS subject, CASE WHEN subject % 2 = 0 THEN 'F' ELSE 'M' END AS sex, foot FROM pixels")
def _(t):
    from solea.sources.images import parse_stem

    return parse_stem(stems(t), "stem")


def stems(t: Inputs):
    sex = F.when(F.col("subject") % 2 == 0, "F").otherwise("M")
    stem = F.concat(F.lit("S"), F.col("subject"), F.lit("_"), sex, F.lit("_"), F.col("foot"))
    return t.pixels.select("image_id", stem.alias("stem")).distinct()


@query("tensor_checks", "images:i shape_ok:b range_ok:b classes_ok:b n0:i n1:i",
       """SELECT count(*) AS images, bool_and(n=64) AS shape_ok, min(lo)>=0 AND max(hi)<=1 AS range_ok, count(DISTINCT y)=2 AS classes_ok,
            count(*) FILTER (y=0) AS n0, count(*) FILTER (y=1) AS n1 FROM (SELECT image_id, y, count(*) AS n, min(v/255.0) AS lo, max(v/255.0) AS hi FROM pixels GROUP BY image_id, y)""")
def _(t):
    from solea.sources.images import tensor_checks

    return tensor_checks(X.scale_255(t.pixels), 8, 8)


# Some images lose their last pixel, some get a value that is none, some a pixel twice
EXTRA_CHECK_VIEWS["damaged_px"] = """SELECT image_id, row_no, col_no, CASE WHEN image_id % 13 = 0 AND row_no = 0 THEN r + 256 ELSE r END AS r FROM rgb_pixels
    WHERE NOT (image_id % 11 = 0 AND row_no = 7 AND col_no = 7) UNION ALL SELECT image_id, row_no, col_no, r FROM rgb_pixels WHERE image_id % 17 = 0 AND row_no = 3 AND col_no = 3"""


@query("batch_outcome", "y:i total:i ok:i failed:i",
       """SELECT y, count(*) AS total, count(*) FILTER (whole) AS ok, count(*) FILTER (NOT whole) AS failed FROM (SELECT DISTINCT image_id, y FROM pixels)
            JOIN (SELECT image_id, count(*)=64 AND count(DISTINCT row_no*8+col_no)=64 AND max(r)<=255 AS whole FROM damaged_px GROUP BY image_id) USING (image_id) GROUP BY y""")
def _(t):
    from solea.sources.images import batch_outcome, faulty_images

    at = lambda row, col: (F.col("row_no") == row) & (F.col("col_no") == col)
    px = t.rgb_pixels
    cut = px.filter(~((F.col("image_id") % 11 == 0) & at(7, 7))).unionByName(px.filter((F.col("image_id") % 17 == 0) & at(3, 3)))
    damaged = cut.withColumn("r", F.when((F.col("image_id") % 13 == 0) & (F.col("row_no") == 0), F.col("r") + 256).otherwise(F.col("r")))
    images = t.pixels.select("image_id", "y").distinct()
    return batch_outcome(images.join(faulty_images(damaged, ["r", "g", "b"], X.IMAGE), "image_id", "left"), ["y"])


@query("grayscale", RC + "v:i", "SELECT image_id, row_no, col_no, CAST(floor(0.299E0*r+0.587E0*g+0.114E0*b) AS INT) AS v FROM rgb_pixels")
def _(t):
    return X.grayscale(t.rgb_pixels)


@query("rgb_to_ydbdr", RC + "Y:f Db:f Dr:f", f"SELECT image_id, row_no, col_no, {_YDD} FROM rgb_pixels")
def _(t):
    return X.rgb_to_ydbdr(t.rgb_pixels)


@query("scale_255", RC + "v:f", "SELECT image_id, row_no, col_no, v/255.0 AS v FROM pixels")
def _(t):
    return X.scale_255(t.pixels)


@query("minmax_norm", RC + "scaled:f",
       """SELECT image_id, row_no, col_no, coalesce((v-min(v) OVER w)/nullif(max(v) OVER w - min(v) OVER w,0),0) AS scaled FROM pixels WINDOW w AS (PARTITION BY image_id)""")
def _(t):
    return X.minmax_norm(t.pixels)


@query("mirror_left", RC + "v:i", "SELECT image_id, row_no, CASE WHEN foot='L' THEN 7-col_no ELSE col_no END AS col_no, v FROM pixels")
def _(t):
    return X.mirror_left(t.pixels, 8)


@query("intensity_histogram", "image_id:i v:i n:i", "SELECT image_id, v, count(*) AS n FROM pixels GROUP BY image_id, v")
def _(t):
    return X.intensity_histogram(t.pixels)


@query("hist_cdf", "image_id:i v:i n:i cum_n:i cum_mass:i", "SELECT * FROM px_cdf")
def _(t):
    return X.hist_cdf(X.intensity_histogram(t.pixels))


@query("otsu_threshold", "image_id:i otsu:i", "SELECT * FROM otsu_rows")
def _(t):
    return X.otsu_threshold(t.pixels)


@query("foot_entropy", "image_id:i entropy:f",
       """SELECT i.image_id, coalesce(e, 0) AS entropy FROM (SELECT DISTINCT image_id FROM pixels) i LEFT JOIN (SELECT image_id, sum(-n/t*log2(n/t)) AS e FROM (
            SELECT image_id, n, sum(n) OVER (PARTITION BY image_id) AS t FROM (SELECT image_id, v, count(*) AS n FROM pixels WHERE v>=128 GROUP BY image_id, v)) GROUP BY image_id) USING (image_id)""")
def _(t):
    return X.foot_entropy(t.pixels, F.col("v") >= 128)


@query("pressure_map", "image_id:i max_pressure:f mean_pressure:f contact_area:i peak_pixels:i",
       """SELECT image_id, max(v)*max(f)/sum(v) AS max_pressure, max(f)/count(*) FILTER (v>0) AS mean_pressure, count(*) FILTER (v>0) AS contact_area,
            count(*) FILTER (v = mx) AS peak_pixels FROM (SELECT image_id, v, max(v) OVER (PARTITION BY image_id) AS mx, (50 + image_id % 40)*9.81 AS f FROM pixels) GROUP BY image_id""")
def _(t):
    weights = t.table("embeddings").select(F.col("vec_id").alias("image_id"), (50 + F.col("vec_id") % 40).alias("weight_kg"))
    per_pixel, summary = X.pressure_map(t.pixels, weights)
    peaks = per_pixel.join(summary.select("image_id", "max_pressure"), "image_id").groupBy("image_id").agg(
        F.count_if(F.col("pressure") >= F.col("max_pressure") * (1 - 1e-12)).alias("peak_pixels"))
    return summary.join(peaks, "image_id")


def labelled(t: Inputs):
    return t.pixels.withColumn("label", F.floor(F.col("v") / 86).cast("int"))


@query("neighbour_label_counts", RC + "nb0:i nb1:i nb2:i", "SELECT * FROM nb_counts")
def _(t):
    return X.neighbour_label_counts(labelled(t), 3)


def energies(df):
    return df.withColumns({f"e{k}": (F.col("v") - mu) * (F.col("v") - mu) / 800.0 for k, mu in enumerate((60, 128, 196))})


@query("hmrf_icm_sweep", RC + "new_label:i",
       """SELECT image_id, row_no, col_no, CASE WHEN a<=b AND a<=c THEN 0 WHEN b<=c THEN 1 ELSE 2 END AS new_label FROM (SELECT *, (v-60)*(v-60)/800.0E0+1.5E0*(4-nb0) AS a,
            (v-128)*(v-128)/800.0E0+1.5E0*(4-nb1) AS b, (v-196)*(v-196)/800.0E0+1.5E0*(4-nb2) AS c FROM nb_counts)""")
def _(t):
    return X.icm_sweep(energies(labelled(t)), 3)


def _swept(before: str) -> str:
    """The labels after one more sweep: two steps of text like those of the single sweep."""
    return f"""SELECT image_id, row_no, col_no, v, CASE WHEN a<=b AND a<=c THEN 0 WHEN b<=c THEN 1 ELSE 2 END AS label FROM (SELECT p.image_id, p.row_no, p.col_no, p.v,
        (p.v-60)*(p.v-60)/800.0E0+1.5E0*(4-count(*) FILTER (q.label=0)) AS a, (p.v-128)*(p.v-128)/800.0E0+1.5E0*(4-count(*) FILTER (q.label=1)) AS b,
        (p.v-196)*(p.v-196)/800.0E0+1.5E0*(4-count(*) FILTER (q.label=2)) AS c
        FROM {before} p JOIN {before} q ON p.image_id=q.image_id AND abs(p.row_no-q.row_no)+abs(p.col_no-q.col_no)=1 GROUP BY p.image_id, p.row_no, p.col_no, p.v)"""


_SWEEPS = 4
EXTRA_CHECK_VIEWS.update({f"icm_{n + 1}": _swept(f"icm_{n}" if n else "labelled_px") for n in range(_SWEEPS)})
CHECK_ONCE.update({f"icm_{n + 1}" for n in range(_SWEEPS)})


# an image of 64 pixels rests only when none moves, and then further sweeps change nothing
@query("hmrf_icm_sweeps", RC + "label:i", f"SELECT image_id, row_no, col_no, label FROM icm_{_SWEEPS}")
def _(t):
    return hmrf_icm(energies(labelled(t)), 3, max_sweeps=_SWEEPS)


@query("cluster_scores", "image_id:i label:i score:f foot:b",
       f"""SELECT image_id, label, score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label)=1 AS foot FROM (SELECT image_id, label,
            avg(Y)*(1+sqrt(pow(avg(abs(Db)),2)+pow(avg(abs(Dr)),2))) AS score FROM (SELECT image_id, r//86 AS label, {_YDD} FROM rgb_pixels) GROUP BY image_id, label)""")
def _(t):
    return X.cluster_scores(X.rgb_to_ydbdr(t.rgb_pixels).withColumn("label", F.floor(F.col("r") / 86).cast("int")))


@query("mask_image", RC + "r:i g:i b:i",
       "SELECT image_id, row_no, col_no, CASE WHEN r>=128 THEN r ELSE 255 END AS r, CASE WHEN r>=128 THEN g ELSE 255 END AS g, CASE WHEN r>=128 THEN b ELSE 255 END AS b FROM rgb_pixels")
def _(t):
    return X.mask_image(t.rgb_pixels, F.col("r") >= 128, ["r", "g", "b"], 255)


@query("gaussian_noise_proxy", "image_id:i noise:f",
       """WITH k AS (SELECT o, exp(-0.5*pow(o/3.0E0,2)) AS w FROM (SELECT unnest(range(-12,13)) AS o)), kn AS (SELECT o, w/sum(w) OVER () AS w FROM k),
          h AS (SELECT a.image_id, a.row_no, a.col_no, sum(w*q.v) AS v FROM pixels a, kn JOIN pixels q ON q.image_id=a.image_id AND q.row_no=a.row_no
            AND q.col_no = CASE WHEN (a.col_no+o+32)%16 < 8 THEN (a.col_no+o+32)%16 ELSE 15-(a.col_no+o+32)%16 END GROUP BY ALL),
          u AS (SELECT a.image_id, a.row_no, a.col_no, sum(w*q.v) AS v FROM h a, kn JOIN h q ON q.image_id=a.image_id AND q.col_no=a.col_no
            AND q.row_no = CASE WHEN (a.row_no+o+32)%16 < 8 THEN (a.row_no+o+32)%16 ELSE 15-(a.row_no+o+32)%16 END GROUP BY ALL)
          SELECT image_id, avg(abs(p.v-u.v)) AS noise FROM pixels p JOIN u USING (image_id,row_no,col_no) GROUP BY image_id""")
def _(t):
    return X.noise_proxy(t.pixels)


def _resize_sql(target: int) -> str:
    return f"""WITH t AS (SELECT o, j, greatest(0.0E0, 1-abs((j-(o+0.5E0)*8/{target}+0.5E0)/greatest(8/{target}.0E0,1.0E0))) AS w FROM (SELECT unnest(range({target})) AS o), (SELECT unnest(range(8)) AS j)),
          k AS (SELECT o, j, w/sum(w) OVER (PARTITION BY o) AS w FROM t WHERE w > 0),
          h AS (SELECT image_id, row_no, o AS col_no, floor(sum(w*v)+0.500000001E0) AS v FROM pixels JOIN k ON k.j=col_no GROUP BY ALL),
          u AS (SELECT image_id, o AS row_no, col_no, floor(sum(w*v)+0.500000001E0) AS v FROM h JOIN k ON k.j=row_no GROUP BY ALL) SELECT * FROM u"""


@query("resize_bilinear", RC + "v:i", _resize_sql(20))
def _(t):
    return X.resize_bilinear(t.pixels, 20)


@query("resize_shrink", RC + "v:i", _resize_sql(5))
def _(t):
    return X.resize_bilinear(t.pixels, 5)


# The table of a tile is a step function of its filled levels: (levels up to v, the cap of 1 leaves one of each) plus the shared excess.
EXTRA_CHECK_VIEWS["clahe_tiles"] = """SELECT image_id, ty, tx, list(v) AS levels, CAST(sum(n-1) AS BIGINT) // 256 AS share, CAST(sum(n-1) AS BIGINT) % 256 AS rest
    FROM (SELECT image_id, row_no//4 AS ty, col_no//4 AS tx, v, count(*) AS n FROM pixels GROUP BY ALL) GROUP BY ALL"""
CHECK_ONCE.add("clahe_tiles")


def _table_sql(t: str) -> str:
    return f"""least(255, round_even((len(list_filter({t}.levels, lambda x: x <= v)) + {t}.share*(v+1)
          + CASE WHEN {t}.rest > 0 THEN least({t}.rest, v // greatest(256//{t}.rest, 1) + 1) ELSE 0 END) * (255.0E0/16), 0))"""


@query("clahe", RC + "v:i",
       f"""WITH p AS (SELECT *, row_no/4.0E0-0.5E0 AS fy, col_no/4.0E0-0.5E0 AS fx FROM pixels),
          q AS (SELECT *, fy-floor(fy) AS ya, fx-floor(fx) AS xa, greatest(floor(fy),0) AS y1, least(floor(fy)+1,1) AS y2, greatest(floor(fx),0) AS x1, least(floor(fx)+1,1) AS x2 FROM p),
          m AS (SELECT q.image_id, row_no, col_no, xa, ya, {_table_sql('a')} AS av, {_table_sql('b')} AS bv, {_table_sql('c')} AS cv, {_table_sql('e')} AS ev FROM q
            JOIN clahe_tiles a ON a.image_id=q.image_id AND a.ty=y1 AND a.tx=x1 JOIN clahe_tiles b ON b.image_id=q.image_id AND b.ty=y1 AND b.tx=x2
            JOIN clahe_tiles c ON c.image_id=q.image_id AND c.ty=y2 AND c.tx=x1 JOIN clahe_tiles e ON e.image_id=q.image_id AND e.ty=y2 AND e.tx=x2)
          SELECT image_id, row_no, col_no, CAST(round_even((av*(1-xa)+bv*xa)*(1-ya)+(cv*(1-xa)+ev*xa)*ya,0) AS INT) AS v FROM m""")
def _(t):
    return X.clahe(t.pixels, 3.5, 2)


@query("clahe_selection", "image_id:i clip:f max_entropy:f")
def _(t):
    """All ten limits, on images put together from 4x4 of the given ones, so that a tile has 256 pixels and the limits give caps of 1 to 6."""
    n = F.col("image_id") % 16
    mosaic = t.pixels.select(
        F.floor(F.col("image_id") / 16).cast("bigint").alias("image_id"), (F.col("row_no") + 8 * F.floor(n / 4)).cast("int").alias("row_no"),
        (F.col("col_no") + 8 * (n % 4)).cast("int").alias("col_no"), "v",
    )
    return X.clahe_selection(mosaic, X.CLIP_LIMITS, 2)
