"""Split queries on the image view."""

from __future__ import annotations

from pyspark.sql import functions as F

from solea.operators import splits as S
from solea.plans.registry import EXTRA_CHECK_VIEWS, Inputs, query


def _hash(key: str, seed: int) -> str:
    first = f"(({key} % 2147483647 * 1103515245 + {12345 + 7919 * seed}) % 2147483648)"
    return f"(({first} % 65536 * 69069 * 32749 + {first} // 65536 * 40503 + {1 + seed}) % 2147483647)"


def _folds(source: str, unit: str, label: str) -> str:
    return f"""WITH o AS (SELECT *, (row_number() OVER (PARTITION BY {label} ORDER BY {_hash(unit, 42)}, {unit}) - 1) % 5 AS outr FROM {source})
        SELECT {unit}, {label}, -1 AS fold FROM o WHERE outr = 0 UNION ALL
        SELECT {unit}, {label}, (row_number() OVER (PARTITION BY {label} ORDER BY {_hash(unit, 43)}, {unit}) - 1) % 5 FROM o WHERE outr <> 0"""


EXTRA_CHECK_VIEWS.update({
    "image_rows": "SELECT DISTINCT image_id, subject, foot, y FROM pixels",
    "patient_rows": "SELECT subject, max(y) AS patient_y FROM image_rows GROUP BY subject",
    "image_folds": _folds("image_rows", "image_id", "y"),
    "patient_folds": _folds("patient_rows", "subject", "patient_y"),
})


def images(t: Inputs):
    return t.table("embeddings").select(
        F.col("vec_id").alias("image_id"), F.floor(F.col("vec_id") / 2).cast("bigint").alias("subject"), (F.col("label") >= 5).cast("int").alias("y")
    )


@query("patient_label", "image_id:i subject:i patient_y:i", "SELECT image_id, subject, patient_y FROM image_rows JOIN patient_rows USING (subject)")
def _(t):
    return S.patient_label(images(t))


@query("cohort_composition", "patients:i images:i all_pos:i all_neg:i mixed:i pos_ratio:f",
       """SELECT count(*) AS patients, sum(n) AS images, count(*) FILTER (lo=1) AS all_pos, count(*) FILTER (hi=0) AS all_neg, count(*) FILTER (lo<>hi) AS mixed, sum(p)/sum(n) AS pos_ratio
          FROM (SELECT subject, min(y) AS lo, max(y) AS hi, count(*) AS n, sum(y) AS p FROM image_rows GROUP BY subject)""")
def _(t):
    return S.cohort_composition(images(t))


@query("stratified_folds", "image_id:i y:i fold:i", "SELECT * FROM image_folds")
def _(t):
    return S.stratified_folds(images(t), "image_id")


@query("grouped_stratified_folds", "image_id:i subject:i y:i fold:i", "SELECT image_id, subject, y, fold FROM image_rows JOIN patient_folds USING (subject)")
def _(t):
    return S.grouped_stratified_folds(images(t))


@query("split_leak_check", "subject:i parts:i", "SELECT subject, count(DISTINCT fold) AS parts FROM image_rows JOIN (SELECT image_id, fold FROM image_folds) USING (image_id) GROUP BY subject HAVING count(DISTINCT fold) > 1")
def _(t):
    return S.split_leaks(S.stratified_folds(images(t), "image_id"))
