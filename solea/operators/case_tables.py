"""Case registry operators: keyed writes, gates, status joins and list views.

Latest-row and first-row choices are aggregates with a full tie-break key, so a case that owns a large share of the
events is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODALITIES = ("podoscope", "thermal")
SIDES = ("L", "R")


def _pick(df: DataFrame, key: list[str], version: list[str], choose) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(choose(F.struct(*rest), F.struct(*version)).alias("__row"))
    return picked.select(*key, "__row.*").select(*df.columns)


def latest(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    return _pick(df, key, version, F.max_by)


def earliest(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    return _pick(df, key, version, F.min_by)


def upsert_latest(target: DataFrame, batch: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Insert or overwrite by key; the highest version wins, also inside the batch."""
    return latest(target.unionByName(batch), key, version)


def insert_if_absent(target: DataFrame, batch: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Keep existing rows; of new keys keep the first writer."""
    fresh = earliest(batch, key, version).join(target.select(*key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def delete_by_key(target: DataFrame, requests: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and for every request whether the key existed."""
    keys = requests.select(*key).distinct()
    outcome = keys.join(target.select(*key, F.lit(True).alias("existed")), key, "left").withColumn(
        "existed", F.coalesce("existed", F.lit(False))
    )
    return target.join(keys, key, "left_anti"), outcome


def id_number(df: DataFrame, column: str = "research_id") -> DataFrame:
    """Rows whose id is P, a digit, then anything; the number is the leading digit run."""
    return df.filter(F.col(column).rlike("^P[0-9]")).withColumn(
        "id_no", F.regexp_extract(column, "^P([0-9]+)", 1).try_cast("bigint")
    )


def id_counters(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        top = id_number(df).agg(F.coalesce(F.max("id_no"), F.lit(0)).alias("top")).select(F.lit(name).alias("name"), "top")
        out = top if out is None else out.unionByName(top)
    return out


def table_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def enum_violations(df: DataFrame, **allowed: tuple[str, ...]) -> DataFrame:
    """Rows that break an allowed-value rule, with the names of the columns that break it."""
    broken = [F.when(F.col(c).isNull() | ~F.col(c).isin(*v), F.lit(c)) for c, v in allowed.items()]
    return df.withColumn("violates", F.concat_ws(",", *broken)).filter(F.col("violates") != "")


def case_flags(captures: DataFrame) -> DataFrame:
    return captures.groupBy("research_id").agg(
        F.bool_or(F.col("modality") == "podoscope").alias("has_podo"),
        F.bool_or(F.col("modality") == "thermal").alias("has_thermal"),
    )


def case_status(cases: DataFrame, forms: DataFrame, captures: DataFrame) -> DataFrame:
    """Cases with a form, their capture flags and per-side category."""
    no = F.lit(False)
    return (
        cases.select("research_id").join(forms, "research_id").join(case_flags(captures), "research_id", "left")
        .withColumns({"has_podo": F.coalesce("has_podo", no), "has_thermal": F.coalesce("has_thermal", no)})
    )


def pending_cases(status: DataFrame) -> DataFrame:
    return status.filter(~(F.col("has_podo") & F.col("has_thermal")))


def roi_ready(status: DataFrame) -> DataFrame:
    return status.filter(F.col("has_podo") & F.col("has_thermal"))


def commit_manifest(commits: DataFrame, captures: DataFrame, preprocessing: DataFrame) -> DataFrame:
    """Commits with their capture paths, newest capture time, status and whether any preprocessing exists, newest first."""
    paths = captures.groupBy("research_id").agg(
        F.max(F.when(F.col("modality") == "podoscope", F.col("raw_path"))).alias("podo_raw"),
        F.max(F.when(F.col("modality") == "thermal", F.col("raw_path"))).alias("thermal"),
        F.max("ts").alias("captured_at"),
    )
    done = preprocessing.groupBy("research_id").agg(F.lit("yes").alias("podo_prepro"))
    blank = F.lit("")
    return (
        commits.join(paths, "research_id", "left").join(done, "research_id", "left")
        .withColumns({c: F.coalesce(c, blank) for c in ("podo_raw", "podo_prepro", "thermal")})
        .withColumn("status", F.when((F.col("podo_raw") != "") & (F.col("thermal") != ""), "complete").otherwise(
            F.when((F.col("podo_raw") != "") | (F.col("thermal") != ""), "partial").otherwise("rejected")))
        .orderBy(F.col("committed_at").desc(), F.col("research_id"))
    )


def commit_status(requests: DataFrame, captures: DataFrame) -> DataFrame:
    """complete with both captures, partial with one, rejected with none."""
    podo, ther = F.coalesce("has_podo", F.lit(False)), F.coalesce("has_thermal", F.lit(False))
    return requests.join(case_flags(captures), "research_id", "left").withColumn(
        "status", F.when(podo & ther, "complete").when(podo | ther, "partial").otherwise("rejected")
    )


def roi_side_state(label: Column, regions: Column) -> Column:
    """Negative feet need no marking; an undecided label still does."""
    return F.when(label == "Negative", "not_needed").when(regions > 0, "done").otherwise("pending")


def form_list_view(forms: DataFrame, manifest_ids: DataFrame, roi: DataFrame) -> DataFrame:
    """Forms, newest id first, with captured flag, region counts and ROI state per side."""
    seen = manifest_ids.select("research_id").distinct().withColumn("captured", F.lit(True))
    out = forms.join(seen, "research_id", "left").join(roi, "research_id", "left")
    zero = F.lit(0)
    out = out.withColumns({
        "captured": F.coalesce("captured", F.lit(False)),
        "regions_l": F.coalesce("regions_l", zero), "regions_r": F.coalesce("regions_r", zero),
    })
    return out.withColumns({
        "state_l": roi_side_state(F.col("label_l"), F.col("regions_l")),
        "state_r": roi_side_state(F.col("label_r"), F.col("regions_r")),
    }).orderBy(F.col("research_id").desc())


def capture_gate(requests: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected capture requests: a capture needs a saved form."""
    ids = forms.select("research_id")
    return requests.join(ids, "research_id", "left_semi"), requests.join(ids, "research_id", "left_anti")


def delete_guard(requests: DataFrame, captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletable forms and forms blocked because a capture exists."""
    ids = captures.select("research_id").distinct()
    return requests.join(ids, "research_id", "left_anti"), requests.join(ids, "research_id", "left_semi")


def orphan_rows(parents: DataFrame, key: str = "research_id", **children: DataFrame) -> DataFrame:
    out = None
    for name, child in children.items():
        rows = child.join(parents.select(key), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.withColumn("child", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def needed_sides(ids: DataFrame, side_labels: DataFrame) -> DataFrame:
    """Sides to annotate: every side whose label is not Negative, and both where there is no form."""
    sides = ids.select("research_id", F.explode(F.array(*map(F.lit, SIDES))).alias("side"))
    joined = sides.join(side_labels, ["research_id", "side"], "left")
    return joined.filter(F.col("label").isNull() | (F.col("label") != "Negative"))


def sides_to_add(needed: DataFrame, existing: DataFrame) -> DataFrame:
    return needed.join(existing.select("research_id", "side"), ["research_id", "side"], "left_anti")


def manifest_display(nested: DataFrame, flat: DataFrame) -> DataFrame:
    """One row of booleans out of two record shapes: nested commit records and flat manifest rows."""
    def filled(c: Column) -> Column:
        return F.coalesce(c != "", F.lit(False))

    a = nested.select(
        "research_id", "status", filled(F.col("podoscope.raw")).alias("podo"),
        F.col("podoscope.preprocessing").isNotNull().alias("prepro"), filled(F.col("thermal.image")).alias("ther"),
    )
    b = flat.select(
        "research_id", "status", filled(F.col("podo_raw")).alias("podo"),
        F.coalesce(F.col("podo_prepro") == "yes", F.lit(False)).alias("prepro"), filled(F.col("thermal")).alias("ther"),
    )
    return a.unionByName(b)


def summary_projection(roi: DataFrame) -> DataFrame:
    """The list view: summaries only. The large project column is never read from Parquet."""
    return roi.select("research_id", "saved_at", "summary").orderBy(F.col("research_id").desc())


def roi_summary(project_sides: DataFrame) -> DataFrame:
    """Region count per side; the stored answer wins, else 'yes' where any region is drawn."""
    stored = F.nullif(F.col("has_risk_area"), F.lit(""))
    return project_sides.withColumn(
        "has_risk_area", F.coalesce(stored, F.when(F.col("region_count") > 0, "yes").otherwise(""))
    )


def roster_union(nurses: DataFrame, team: DataFrame) -> DataFrame:
    return nurses.union(team).distinct()


def iso_local(ts: Column) -> Column:
    """A UTC instant as local +07:00 ISO text without fractions."""
    local = F.date_trunc("second", ts) + F.expr("INTERVAL 7 HOURS")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00"))


def iso_to_utc(text: Column) -> Column:
    return F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssXXX")
