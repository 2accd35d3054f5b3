"""Rule-based risk scoring of case record forms, and the exports built on it.

``fields`` is MAP<STRING,STRING>: an absent key, null and '' all count as unanswered; a ticked box is 'true'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field keys, deformity items with their printed labels, and the texts of the missing-item list.
MONOFILAMENT_SITES = ("hallux", "mth1", "mth5")
DEFORMITY_LABELS = {
    "hammer": "นิ้วเท้าโก่ง",
    "mallet": "นิ้วเท้าพับ",
    "claw": "นิ้วเท้างอ",
    "hallux": "นิ้วหัวแม่เท้าเอียง",
    "mth_prom": "หัวกระดูก Metatarsal โปน",
    "bony": "กระดูกยื่นผิดปกติขนาดใหญ่",
    "cavus": "เท้าโก่ง อุ้งเท้าสูง",
    "planus": "เท้าแบน",
    "equinus": "เท้าจิก",
    "charcot": "เท้าผิดรูปจากโรคชาร์โคต์",
    "ljm": "การเคลื่อนไหวข้อต่อจำกัด",
    "trauma": "บาดเจ็บที่เท้าที่หายแล้ว",
    "surgery": "การผ่าตัดเท้าอื่นๆ",
}
SIDE_LABELS = {"L": "เท้าซ้าย", "R": "เท้าขวา"}
MISSING_MONOFILAMENT = "โมโนฟิลาเมนต์"
MISSING_ULCER = "ประวัติแผล"
MISSING_AMPUTATION = "การตัดรยางค์"
NEED_ID = "รหัสวิจัย"
NEED_CKD = "ไตวายระยะสุดท้าย (CKD stage 5)"
NEED_EXAMINERS = "พยาบาลผู้ตรวจ"
NEED_TWO_EXAMINERS = "พยาบาลผู้ตรวจซ้ำกัน"


def _answer(fields: Column, name: Column | str) -> Column:
    key = F.lit(name) if isinstance(name, str) else name
    return F.nullif(F.try_element_at(fields, key), F.lit(""))


def _is(value: Column, text: str) -> Column:
    return F.coalesce(value == text, F.lit(False))


def score_side(forms: DataFrame, side: str = "side", fields: str = "fields") -> DataFrame:
    """Score one foot per row: lops, pad, deformities, history, category 0-3, label and missing items."""
    f, s = F.col(fields), F.col(side)
    item = lambda prefix, rest="": _answer(f, F.concat(F.lit(prefix), s, F.lit(rest)))
    sites = [item("mf_", f"_{k}") for k in MONOFILAMENT_SITES]
    answered = reduce(lambda a, b: a + b, [m.isNotNull().cast("int") for m in sites])
    felt = reduce(lambda a, b: a + b, [_is(m, "y").cast("int") for m in sites])
    df = forms.withColumns({"__answered": answered, "__felt": felt, "__abi": item("abi_"), "__tbi": item("tbi_")})
    answered, felt, abi, tbi = F.col("__answered"), F.col("__felt"), F.col("__abi"), F.col("__tbi")
    # two felt sites settle "no loss"; two sites not felt, or too few left to reach two, settle "loss"
    lops = F.when(felt >= 2, False).when((answered == 3) | (3 - answered < 2 - felt), True)
    pad = F.when(abi == "pad", True).when(abi == "normal", False).when((abi == "calcified") & tbi.isNotNull(), tbi == "pad")
    ticked = F.array_compact(F.array(*[F.when(item("def_", f"_{k}").isNotNull(), F.lit(v)) for k, v in DEFORMITY_LABELS.items()]))
    ulcer, amp, ckd = item("ulcer_"), item("amp_"), _answer(f, "ckd")
    missing = F.array_compact(F.array(
        F.when(answered < 3, MISSING_MONOFILAMENT),
        F.when(abi.isNull(), "ABI"),
        F.when(_is(abi, "calcified") & tbi.isNull(), "TBI"),
        F.when(ulcer.isNull(), MISSING_ULCER),
        F.when(amp.isNull(), MISSING_AMPUTATION),
    ))
    df = df.withColumns({
        "lops": lops, "pad": pad, "deformities": ticked, "missing": missing,
        "history": _is(ulcer, "yes") | _is(amp, "yes") | _is(ckd, "yes"),
    })
    df = df.withColumn("deformity", F.size("deformities") > 0)
    either, both = F.col("lops") | F.col("pad"), F.col("lops") & F.col("pad")
    category = (
        F.when(F.col("lops").isNull() | F.col("pad").isNull(), F.lit(None).cast("int"))
        .when(either & F.col("history"), 3).when(both | (either & F.col("deformity")), 2).when(either, 1).otherwise(0)
    )
    df = df.withColumn("category", category)
    return df.withColumns({
        "label": risk_label(F.col("category")),
        "history_only": F.col("history") & F.coalesce(~F.col("lops") & ~F.col("pad"), F.lit(False)),
        "need_tbi": _is(abi, "calcified"),
    }).drop("__answered", "__felt", "__abi", "__tbi")


def risk_label(category: Column) -> Column:
    return F.when(category >= 1, "Positive").when(category == 0, "Negative")


def explode_sides(forms: DataFrame) -> DataFrame:
    return forms.withColumn("side", F.explode(F.array(F.lit("L"), F.lit("R"))))


def score_forms(forms: DataFrame) -> DataFrame:
    """One row per form with the scored sides as structs ``L`` and ``R``; one pass, no shuffle."""
    record = ("lops", "pad", "deformity", "deformities", "history", "category", "label", "missing")
    out = forms
    for s in ("L", "R"):
        scored = score_side(out.withColumn("side", F.lit(s)))
        out = scored.withColumn(f"__{s}", F.struct(*record)).drop(*record, "side", "history_only", "need_tbi")
    return out.withColumnsRenamed({"__L": "L", "__R": "R"})


def worst_side(left: Column, right: Column) -> Column:
    """The higher known category of the two feet, null when neither is known."""
    return F.greatest(left, right)


def form_missing_items(scored: DataFrame) -> DataFrame:
    """All items that keep a form from being complete, in form order."""
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")).isNull()
    head = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("pid", F.lit(""))) == "", NEED_ID),
        F.when(_answer(F.col("fields"), "ckd").isNull(), NEED_CKD),
        F.when(blank("nurse") | blank("nurse2"), NEED_EXAMINERS),
        F.when(~blank("nurse") & (F.col("nurse") == F.col("nurse2")), NEED_TWO_EXAMINERS),
    ))

    def named(side: str) -> Column:
        return F.transform(F.col(f"{side}.missing"), lambda m: F.concat(F.lit(SIDE_LABELS[side] + ": "), m))

    sides = [named(s) for s in SIDE_LABELS]
    return scored.withColumn("need", F.concat(head, *sides))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


# The column order of both exports.
RAW_COLUMNS = (
    ["pid", "savedAt"]
    + [f"mf_{s}_{m}" for s in "LR" for m in MONOFILAMENT_SITES]
    + [f"{p}_{s}" for s in "LR" for p in ("abi", "tbi")]
    + [f"deformity_{s}" for s in "LR"]
    + [f"{p}_{s}" for s in "LR" for p in ("ulcer", "amp")]
    + ["ckd", "note", "nurse", "nurse2"]
    + [f"{p}_{s}" for s in "LR" for p in ("lops", "pad", "history", "iwgdf_category", "iwgdf_label")]
    + ["iwgdf_category_patient", "iwgdf_label_patient"]
)
TRAINING_COLUMNS = ["pid", "side", "category", "label", "lops", "pad", "deformity", "deformities", "history"]


def raw_form_export(scored: DataFrame) -> DataFrame:
    """One wide row per form in printed-form order; blanks for nulls, deformities collapsed to one flag per foot."""
    worst = worst_side(F.col("L.category"), F.col("R.category"))
    derived = {"pid": F.col("pid"), "savedAt": F.col("savedAt"), "nurse": F.col("nurse"), "nurse2": F.col("nurse2"),
               "iwgdf_category_patient": worst, "iwgdf_label_patient": risk_label(worst)}
    for s in "LR":
        derived |= {f"{p}_{s}": F.col(f"{s}.{p}") for p in ("deformity", "lops", "pad", "history")}
        derived |= {f"iwgdf_{p}_{s}": F.col(f"{s}.{p}") for p in ("category", "label")}
    return scored.select(*[_text(derived[c] if c in derived else F.try_element_at("fields", F.lit(c))).alias(c) for c in RAW_COLUMNS])


def training_export(scored: DataFrame) -> DataFrame:
    """Two rows per form, one per foot, with the deformity list joined by '; '."""
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("r")) for s in "LR"]))
    rows = scored.select("pid", side.alias("x")).select("pid", "x.side", "x.r.*")
    return rows.withColumn("deformities", F.array_join("deformities", "; ")).select(
        *[_text(F.col(c)).alias(c) for c in TRAINING_COLUMNS]
    )


def csv_line(columns: list[str]) -> Column:
    """Every value quoted, inner quotes doubled, nulls empty."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(_text(F.col(c)), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[cell(c) for c in columns])


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(csv_line(columns).alias("value"))


def abi_band(abi: Column) -> Column:
    return F.when(abi < 0.90, "pad").when(abi <= 1.30, "normal").when(abi > 1.30, "calcified")


def tbi_band(tbi: Column) -> Column:
    return F.when(tbi < 0.70, "pad").when(tbi >= 0.70, "normal")
