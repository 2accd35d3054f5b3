"""Form scoring and export queries on the form view."""

from __future__ import annotations

from pyspark.sql import functions as F

from solea.operators import case_tables as C
from solea.operators import risk_rules as R
from solea.plans.registry import EXTRA_CHECK_VIEWS, Inputs, query

EXTRA_CHECK_VIEWS.update({
    "side_answers": """SELECT *, CASE WHEN mf1<>'' THEN 1 ELSE 0 END + CASE WHEN mf2<>'' THEN 1 ELSE 0 END + CASE WHEN mf3<>'' THEN 1 ELSE 0 END AS answered,
        CASE WHEN mf1='y' THEN 1 ELSE 0 END + CASE WHEN mf2='y' THEN 1 ELSE 0 END + CASE WHEN mf3='y' THEN 1 ELSE 0 END AS felt FROM forms""",
    "side_flags": f"""SELECT *, CASE WHEN answered = 3 THEN felt < 2 WHEN felt < 2 AND 3-answered < 2-felt THEN true WHEN felt >= 2 THEN false END AS lops,
        CASE WHEN abi='pad' THEN true WHEN abi='normal' THEN false WHEN abi='calcified' AND tbi<>'' THEN tbi='pad' END AS pad,
        def_hammer OR def_charcot AS deformity,
        concat_ws('; ', CASE WHEN def_hammer THEN '{R.DEFORMITY_LABELS['hammer']}' END, CASE WHEN def_charcot THEN '{R.DEFORMITY_LABELS['charcot']}' END) AS deformities,
        coalesce(ulcer='yes',false) OR coalesce(amp='yes',false) OR coalesce(ckd='yes',false) AS history,
        concat_ws('; ', CASE WHEN answered<3 THEN '{R.MISSING_MONOFILAMENT}' END, CASE WHEN coalesce(abi,'')='' THEN 'ABI' END,
          CASE WHEN abi='calcified' AND coalesce(tbi,'')='' THEN 'TBI' END, CASE WHEN coalesce(ulcer,'')='' THEN '{R.MISSING_ULCER}' END,
          CASE WHEN coalesce(amp,'')='' THEN '{R.MISSING_AMPUTATION}' END) AS missing FROM side_answers""",
    "side_scores": """SELECT *, CASE WHEN category >= 1 THEN 'Positive' WHEN category = 0 THEN 'Negative' END AS label,
        history AND coalesce(NOT lops AND NOT pad, false) AS history_only FROM (
        SELECT *, CASE WHEN lops IS NULL OR pad IS NULL THEN NULL WHEN (lops OR pad) AND history THEN 3 WHEN lops AND pad THEN 2
          WHEN (lops OR pad) AND deformity THEN 2 WHEN lops OR pad THEN 1 ELSE 0 END AS category FROM side_flags)""",
})


def form_records(t: Inputs):
    """Whole forms: one field map per person, merged from the two side rows of the view."""
    key = lambda p, r="": F.concat(F.lit(p), "side", F.lit(r))
    box = lambda c: F.when(F.col(c), "true").otherwise("")
    entries = F.array(*[F.struct(k.alias("k"), v.alias("v")) for k, v in (
        (key("mf_", "_hallux"), F.col("mf1")), (key("mf_", "_mth1"), F.col("mf2")), (key("mf_", "_mth5"), F.col("mf3")),
        (key("abi_"), F.col("abi")), (key("tbi_"), F.col("tbi")), (key("def_", "_hammer"), box("def_hammer")),
        (key("def_", "_charcot"), box("def_charcot")), (key("ulcer_"), F.col("ulcer")), (key("amp_"), F.col("amp")),
    )])
    people = t.forms.groupBy("pid_no").agg(
        F.flatten(F.collect_list(entries)).alias("entries"), F.first("ckd").alias("ckd"), F.first("nurse").alias("nurse")
    )
    n = F.col("pid_no")
    return people.select(
        "pid_no", F.when(n % 31 == 0, " ").otherwise(F.concat(F.lit("P"), n)).alias("pid"),
        F.map_from_entries(F.concat("entries", F.array(F.struct(F.lit("ckd").alias("k"), F.col("ckd").alias("v"))))).alias("fields"),
        F.when(n % 9 == 0, "").otherwise(F.col("nurse")).alias("nurse"),
        F.when(n % 5 == 0, F.col("nurse")).when(n % 7 != 0, 'nurse "b"').alias("nurse2"),
        F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0")).alias("savedAt"),
    )


_PERSON = """(SELECT pid_no, CASE WHEN pid_no % 31 = 0 THEN ' ' ELSE 'P' || CAST(pid_no AS VARCHAR) END AS pid,
  CASE WHEN pid_no % 9 = 0 THEN '' ELSE nurse END AS nurse, CASE WHEN pid_no % 5 = 0 THEN nurse WHEN pid_no % 7 <> 0 THEN 'nurse "b"' END AS nurse2,
  '2024-01-' || lpad(CAST(pid_no % 28 + 1 AS VARCHAR), 2, '0') AS saved_at, ckd FROM forms WHERE side = 'L')"""


def scored(t: Inputs):
    return R.score_forms(form_records(t))


def scored_sides(t: Inputs):
    return R.score_side(R.explode_sides(form_records(t)))


@query("risk_scoring", "pid_no:i side:s lops:b pad:b deformity:b deformities:s history:b category:i label:s history_only:b missing:s", "SELECT * FROM side_scores")
def _(t):
    df = scored_sides(t)
    return df.withColumns({"deformities": F.array_join("deformities", "; "), "missing": F.array_join("missing", "; ")})


@query("risk_label", "pid_no:i side:s label:s", "SELECT pid_no, side, label FROM side_scores")
def _(t):
    return scored_sides(t).withColumn("label", R.risk_label(F.col("category")))


@query("form_missing_items", "pid_no:i need:s",
       f"""SELECT p.pid_no, concat_ws('; ', CASE WHEN trim(pid)='' THEN '{R.NEED_ID}' END, CASE WHEN coalesce(p.ckd,'')='' THEN '{R.NEED_CKD}' END,
            CASE WHEN coalesce(p.nurse,'')='' OR coalesce(nurse2,'')='' THEN '{R.NEED_EXAMINERS}' END,
            CASE WHEN coalesce(p.nurse,'')<>'' AND p.nurse=nurse2 THEN '{R.NEED_TWO_EXAMINERS}' END,
            CASE WHEN l.missing<>'' THEN '{R.SIDE_LABELS['L']}: ' || replace(l.missing, '; ', '; {R.SIDE_LABELS['L']}: ') END,
            CASE WHEN r.missing<>'' THEN '{R.SIDE_LABELS['R']}: ' || replace(r.missing, '; ', '; {R.SIDE_LABELS['R']}: ') END) AS need
          FROM {_PERSON} p JOIN side_scores l ON l.pid_no=p.pid_no AND l.side='L' JOIN side_scores r ON r.pid_no=p.pid_no AND r.side='R'""")
def _(t):
    return R.form_missing_items(scored(t)).withColumn("need", F.array_join("need", "; "))


@query("worst_side", "pid_no:i category:i label:s",
       """SELECT *, CASE WHEN category >= 1 THEN 'Positive' WHEN category = 0 THEN 'Negative' END AS label FROM (
            SELECT pid_no, max(category) AS category FROM side_scores GROUP BY pid_no)""")
def _(t):
    worst = R.worst_side(F.col("L.category"), F.col("R.category"))
    return scored(t).select("pid_no", worst.alias("category"), R.risk_label(worst).alias("label"))


def _raw_sql_columns() -> dict[str, str]:
    text = lambda e: f"coalesce(CAST({e} AS VARCHAR), '')"
    out = {"pid": "pid", "savedAt": "saved_at", "ckd": text("p.ckd"), "note": "''", "nurse": text("p.nurse"), "nurse2": text("nurse2"),
           "iwgdf_category_patient": text("greatest(l.category, r.category)"),
           "iwgdf_label_patient": text("CASE WHEN greatest(l.category, r.category) >= 1 THEN 'Positive' WHEN greatest(l.category, r.category) = 0 THEN 'Negative' END")}
    for s, a in (("L", "l"), ("R", "r")):
        out |= {f"mf_{s}_{m}": text(f"{a}.mf{i}") for i, m in enumerate(R.MONOFILAMENT_SITES, 1)}
        out |= {f"{p}_{s}": text(f"{a}.{p}") for p in ("abi", "tbi", "ulcer", "amp", "deformity", "lops", "pad", "history")}
        out |= {f"iwgdf_{p}_{s}": text(f"{a}.{p}") for p in ("category", "label")}
    return out


_RAW_FROM = f"FROM {_PERSON} p JOIN side_scores l ON l.pid_no=p.pid_no AND l.side='L' JOIN side_scores r ON r.pid_no=p.pid_no AND r.side='R'"


@query("raw_form_export", " ".join(f"{c}:s" for c in R.RAW_COLUMNS),
       "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _raw_sql_columns().items()) + " " + _RAW_FROM)
def _(t):
    return R.raw_form_export(scored(t))


_TRAIN = """SELECT p.pid, s.side, coalesce(CAST(category AS VARCHAR),'') AS category, coalesce(label,'') AS label, coalesce(CAST(lops AS VARCHAR),'') AS lops,
  coalesce(CAST(pad AS VARCHAR),'') AS pad, CAST(deformity AS VARCHAR) AS deformity, deformities, CAST(history AS VARCHAR) AS history
  FROM side_scores s JOIN """ + _PERSON + " p ON p.pid_no = s.pid_no"


@query("training_export", " ".join(f"{c}:s" for c in R.TRAINING_COLUMNS), _TRAIN)
def _(t):
    return R.training_export(scored(t))


@query("export_csv_quoted", "value:s",
       "SELECT concat_ws(',', " + ", ".join(f"""'"' || replace({e}, '"', '""') || '"'""" for e in (_raw_sql_columns()[c] for c in R.RAW_COLUMNS)) + ") AS value " + _RAW_FROM)
def _(t):
    return R.csv_lines(R.raw_form_export(scored(t)), R.RAW_COLUMNS)


@query("abi_band", "pid_no:i abi_band:s tbi_band:s",
       """SELECT pid_no, CASE WHEN a < 0.9 THEN 'pad' WHEN a <= 1.3 THEN 'normal' ELSE 'calcified' END AS abi_band, CASE WHEN b < 0.7 THEN 'pad' ELSE 'normal' END AS tbi_band
          FROM (SELECT c_custkey AS pid_no, c_custkey % 200 / 100.0E0 AS a, c_custkey % 97 / 100.0E0 AS b FROM customer)""")
def _(t):
    k = F.col("c_custkey")
    return t.table("customer").select(k.alias("pid_no"), R.abi_band(k % 200 / 100.0).alias("abi_band"), R.tbi_band(k % 97 / 100.0).alias("tbi_band"))


@query("roster_union", "name:s", "SELECT DISTINCT nurse AS name FROM forms UNION SELECT DISTINCT o_orderpriority FROM orders")
def _(t):
    return C.roster_union(t.forms.select(F.col("nurse").alias("name")), t.table("orders").select("o_orderpriority"))


@query("union_groups", "subject:i grp:s age:f",
       "SELECT subject, 'CT' AS grp, age FROM demographics WHERE subject % 2 = 0 UNION ALL SELECT subject, 'DM', age FROM demographics WHERE subject % 2 = 1")
def _(t):
    d = t.demographics
    ct = d.filter("subject % 2 = 0").select("subject", F.lit("CT").alias("grp"), "age")
    return ct.unionByName(d.filter("subject % 2 = 1").select("age", "subject", F.lit("DM").alias("grp")))
