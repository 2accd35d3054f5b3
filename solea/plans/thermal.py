"""Temperature feature queries on the zone view."""

from __future__ import annotations

from pyspark.sql import functions as F

from solea.operators import thermal as T
from solea.plans.registry import EXTRA_CHECK_VIEWS, Inputs, query

KEY = ["image_id", "subject", "foot", "zone"]
_CLASSES = "[" + ",".join(str(c) for c in T.CLASS_TEMPS) + "]"
EXTRA_CHECK_VIEWS.update({
    "warm": "SELECT * FROM zone_temps WHERE temp > 0",
    "near": f"""SELECT w.*, list_position(list_transform({_CLASSES}, lambda c: abs(w.temp - c)), list_min(list_transform({_CLASSES}, lambda c: abs(w.temp - c)))) AS cls FROM warm w""",
    "shares": "SELECT image_id, subject, foot, zone, cls, count(*) AS n FROM near GROUP BY ALL",
    "modes": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, zone ORDER BY n DESC, cls) AS rn FROM shares) WHERE rn = 1",
    "ets": f"""SELECT m.image_id, m.subject, m.foot, m.zone, sum(s.n * {_CLASSES}[s.cls]) / sum(s.n) AS et FROM modes m JOIN shares s
        ON s.image_id=m.image_id AND s.zone=m.zone AND abs(s.cls - m.cls) <= 1 GROUP BY ALL""",
    "zone_rows": """SELECT image_id, zone, count(*) AS pixels, avg(temp) AS mean, median(temp) AS median, stddev_pop(temp) AS sd, max(temp) AS hottest,
        avg(CASE WHEN temp <= 26.5 THEN 1.0 ELSE 0 END) AS ntr1, avg(CASE WHEN temp > 26.5 AND temp <= 28.5 THEN 1.0 ELSE 0 END) AS ntr2,
        avg(CASE WHEN temp > 28.5 AND temp <= 30.5 THEN 1.0 ELSE 0 END) AS ntr3, avg(CASE WHEN temp > 30.5 AND temp <= 32.5 THEN 1.0 ELSE 0 END) AS ntr4,
        avg(CASE WHEN temp > 32.5 THEN 1.0 ELSE 0 END) AS ntr5 FROM warm GROUP BY image_id, zone""",
    "thermal_images": "SELECT DISTINCT image_id, subject, foot, CASE WHEN subject % 3 = 0 THEN 'F' ELSE 'M' END AS gender FROM zone_temps",
})


def images(t: Inputs):
    g = F.when(F.col("subject") % 3 == 0, "F").otherwise("M").alias("gender")
    return t.zone_temps.select("image_id", "subject", "foot", g).distinct()


@query("nonzero_pixels", "image_id:i zone:s temp:f", "SELECT image_id, zone, temp FROM warm")
def _(t):
    return T.nonzero_pixels(t.zone_temps)


@query("nearest_class", "image_id:i zone:s temp:f cls:i", "SELECT image_id, zone, temp, cls - 1 AS cls FROM near")
def _(t):
    return T.nonzero_pixels(t.zone_temps).withColumn("cls", T.nearest_class(F.col("temp")))


@query("zone_stats", "image_id:i zone:s pixels:i mean:f median:f sd:f", "SELECT * FROM zone_rows")
def _(t):
    return T.zone_features(t.zone_temps, ["image_id", "zone"])


@query("ntr_fractions", "image_id:i zone:s ntr1:f ntr2:f ntr3:f ntr4:f ntr5:f", "SELECT * FROM zone_rows")
def _(t):
    return T.zone_features(t.zone_temps, ["image_id", "zone"])


@query("estimated_temp", "image_id:i zone:s et:f", "SELECT * FROM ets")
def _(t):
    return T.estimated_temp(t.zone_temps, ["image_id", "zone"])


@query("hottest_dev", "image_id:i zone:s hottest:f hse:f", "SELECT image_id, zone, hottest, abs(hottest - et) AS hse FROM zone_rows JOIN ets USING (image_id, zone)")
def _(t):
    return T.hottest_deviation(t.zone_temps, ["image_id", "zone"])


@query("opposite_foot", "image_id:i zone:s etd:f",
       "SELECT a.image_id, a.zone, abs(a.et - coalesce(b.et, 0)) AS etd FROM ets a LEFT JOIN ets b ON a.subject=b.subject AND a.zone=b.zone AND a.foot<>b.foot")
def _(t):
    return T.opposite_foot(T.estimated_temp(t.zone_temps, KEY), ["subject"])


@query("demographics_join", "image_id:i Age:f Gender:f TCI:f missing_subject:b",
       """SELECT i.image_id, coalesce(d.age,0) AS Age, CASE WHEN coalesce(d.gender, i.gender)='F' THEN 1 ELSE 0 END AS Gender,
            coalesce(CASE WHEN foot='L' THEN tci_l ELSE tci_r END, 0) AS TCI, d.subject IS NULL AS missing_subject
          FROM thermal_images i LEFT JOIN demographics d USING (subject)""")
def _(t):
    return T.join_demographics(images(t), t.demographics)


def _matrix_sql() -> str:
    cols = ["CAST(coalesce(d.age,0) AS FLOAT) AS Age", "CAST(CASE WHEN coalesce(d.gender, i.gender)='F' THEN 1 ELSE 0 END AS FLOAT) AS Gender",
            "CAST(coalesce(CASE WHEN i.foot='L' THEN tci_l ELSE tci_r END, 0) AS FLOAT) AS TCI", "CAST(coalesce(FullFoot.hottest,0) AS FLOAT) AS HighestTemp"]
    cols += [f"CAST(coalesce(FullFoot.ntr{i},0) AS FLOAT) AS NTR_Class{i}" for i in range(1, 6)]
    joins = ""
    for z in T.ZONES:
        e = f"coalesce(e_{z}.et,0)"
        cols += [f"CAST(coalesce({z}.{c},0) AS FLOAT) AS {z}_{s}" for s, c in (("Mean", "mean"), ("Median", "median"), ("SD", "sd"))]
        cols += [f"CAST({e} AS FLOAT) AS {z}_ET", f"CAST(abs({e} - coalesce(o_{z}.et,0)) AS FLOAT) AS {z}_ETD", f"CAST(coalesce(abs({z}.hottest - e_{z}.et),0) AS FLOAT) AS {z}_HSE"]
        joins += f" LEFT JOIN zone_rows {z} ON {z}.image_id=i.image_id AND {z}.zone='{z}' LEFT JOIN ets e_{z} ON e_{z}.image_id=i.image_id AND e_{z}.zone='{z}'"
        joins += f" LEFT JOIN ets o_{z} ON o_{z}.subject=i.subject AND o_{z}.foot<>i.foot AND o_{z}.zone='{z}'"
    return f"SELECT i.image_id, {', '.join(cols)} FROM thermal_images i LEFT JOIN demographics d USING (subject){joins}"


@query("thermal_feature_matrix", "image_id:i " + " ".join(f"{c}:f" for c in T.FEATURE_NAMES), _matrix_sql())
def _(t):
    return T.feature_matrix(images(t), t.zone_temps, t.demographics)
