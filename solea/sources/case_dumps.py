"""Flat JSON and CSV dumps of the case registry, annotation documents, and case table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solea.operators.boxes import shape_box
from solea.operators.risk_rules import csv_line

# Fixed value: the only accepted form of an annotated image's file name.
SAFE_FILENAME = r"^/api/file/podo/P\d{4}/preprocessing/P\d{4}_podo_[LR]_full\.png$"

SIDE = "STRUCT<lops: BOOLEAN, pad: BOOLEAN, deformity: BOOLEAN, deformities: ARRAY<STRING>, history: BOOLEAN, category: INT, label: STRING>"
FORM_SCHEMA = f"pid STRING, nurse STRING, nurse2 STRING, savedAt STRING, data STRUCT<fields: MAP<STRING,STRING>, derived: STRUCT<L: {SIDE}, R: {SIDE}>>, schema_version STRING, _bad STRING"
COMMIT_SCHEMA = (
    "research_id STRING, captured_at STRING, operator STRING, podoscope STRUCT<raw: STRING, preprocessing: MAP<STRING,STRING>>, "
    "thermal STRUCT<image: STRING, radiometric: STRING>, status STRING, _bad STRING"
)
ROI_SCHEMA = "rid STRING, savedAt STRING, summary MAP<STRING,STRUCT<region_count: INT, has_risk_area: STRING, filename: STRING>>, project STRING, _bad STRING"


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """One JSON document per file with the file's stem."""
    return named_documents(spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).withColumn("path", F.input_file_name()))


def named_documents(files: DataFrame) -> DataFrame:
    """The same out of files as rows ``(path, value)``."""
    stem = F.regexp_extract("path", r"/(?:file=)?([^/=]+?)(?:\.json)?(?:/part-[^/]*)?$", 1)
    return files.select(stem.alias("stem"), "value")


def parse_documents(docs: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good documents as columns, and the stems of those that are not valid JSON."""
    doc = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = docs.select("stem", doc.alias("d")).select("stem", "d.*")
    return parsed.filter(F.col("_bad").isNull()).drop("_bad"), parsed.filter(F.col("_bad").isNotNull()).select("stem")


def _or(c: str, default: Column | str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), default if isinstance(default, Column) else F.lit(default))


def import_forms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Form rows with defaults; the key falls back to the file stem, a second file of the same key replaces the first."""
    good, bad = parse_documents(docs, FORM_SCHEMA)
    rows = good.select(
        _or("pid", F.col("stem")).alias("research_id"), F.coalesce("nurse", F.lit("")).alias("nurse"), F.coalesce("nurse2", F.lit("")).alias("nurse2"),
        F.coalesce("savedAt", F.lit("")).alias("saved_at"), F.col("data.fields").alias("fields"), F.col("data.derived").alias("derived"),
        F.coalesce("schema_version", F.lit("1.0")).alias("schema_version"), "stem",
    )
    rest = [c for c in rows.columns if c not in ("research_id", "stem")]
    last = rows.groupBy("research_id").agg(F.max_by(F.struct(*rest), "stem").alias("r"))
    return last.select("research_id", "r.*"), bad


def import_commits(docs: DataFrame) -> dict[str, DataFrame]:
    """Captures and preprocessing rows out of nested commit documents."""
    good, bad = parse_documents(docs, COMMIT_SCHEMA)
    base = good.select(_or("research_id", F.col("stem")).alias("research_id"), F.coalesce("captured_at", F.lit("")).alias("captured_at"), "podoscope", "thermal")
    shots = F.array(
        F.struct(F.lit("podoscope").alias("modality"), F.col("podoscope.raw").alias("raw_path")),
        F.struct(F.lit("thermal").alias("modality"), F.col("thermal.image").alias("raw_path")),
    )
    captures = base.select("research_id", "captured_at", F.explode(shots).alias("s")).select("research_id", "captured_at", "s.*").filter(F.col("raw_path") != "")
    prepro = base.select("research_id", F.explode("podoscope.preprocessing").alias("side", "path")).filter(F.col("side").isin("L", "R") & (F.col("path") != ""))
    return {"captures": captures, "preprocessing": prepro, "bad": bad}


def import_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Commit rows out of the manifest CSV; rows without an id are skipped."""
    df = spark.read.option("header", "true").csv(path)
    return df.select(F.trim("research_id").alias("research_id"), "status", F.col("captured_at").alias("committed_at")).filter(F.col("research_id") != "")


def import_roi(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    good, bad = parse_documents(docs, ROI_SCHEMA)
    return good.select(_or("rid", F.col("stem")).alias("research_id"), F.coalesce("savedAt", F.lit("")).alias("saved_at"), "summary", "project"), bad


VIA3_SCHEMA = (
    "file MAP<STRING,STRUCT<fid: STRING, fname: STRING>>, attribute MAP<STRING,STRUCT<aname: STRING, options: MAP<STRING,STRING>>>, "
    "metadata MAP<STRING,STRUCT<vid: STRING, xy: ARRAY<DOUBLE>, av: MAP<STRING,STRING>>>"
)


def parse_via3_boxes(docs: DataFrame, value: str = "value") -> DataFrame:
    """Rectangles (``xy = [2, x, y, w, h]``) of a project document, with file name and attribute code as option text."""
    doc = docs.select(F.from_json(value, VIA3_SCHEMA).alias("d")).select("d.*")
    rows = doc.select("file", "attribute", F.explode("metadata").alias("region_id", "m")).filter(F.get("m.xy", F.lit(0)) == 2)
    code = F.map_filter("attribute", lambda k, v: F.array_contains(F.map_keys("m.av"), k))
    first = F.get(F.map_keys(code), F.lit(0))
    return rows.select(
        "region_id", F.try_element_at("file", F.col("m.vid"))["fname"].alias("fname"),
        *[F.get("m.xy", F.lit(i)).alias(c) for i, c in enumerate(("x", "y", "w", "h"), 1)],
        F.try_element_at(F.try_element_at("attribute", first)["options"], F.try_element_at("m.av", first)).alias("tag"),
    )


VIA2_SHAPE = (
    "STRUCT<name: STRING, x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE, cx: DOUBLE, cy: DOUBLE, r: DOUBLE, rx: DOUBLE, ry: DOUBLE, "
    "all_points_x: ARRAY<DOUBLE>, all_points_y: ARRAY<DOUBLE>>"
)
VIA2_SCHEMA = (
    "_via_img_metadata MAP<STRING,STRUCT<filename: STRING, file_attributes: MAP<STRING,STRING>, "
    f"regions: ARRAY<STRUCT<shape_attributes: {VIA2_SHAPE}, region_attributes: MAP<STRING,STRING>>>>>"
)


def parse_via2_shapes(docs: DataFrame, value: str = "value") -> DataFrame:
    """Shapes per side with their bounding box; images without a side L or R are left out."""
    keep = [c for c in docs.columns if c != value]
    images = docs.select(*keep, F.explode(F.from_json(value, VIA2_SCHEMA)["_via_img_metadata"]).alias("img", "m"))
    side = F.try_element_at("m.file_attributes", F.lit("foot_side"))
    shapes = images.select(*keep, side.alias("side"), F.posexplode("m.regions").alias("at", "region")).filter(F.col("side").isin("L", "R"))
    return shapes.select(*keep, "side", "at", F.col("region.shape_attributes.name").alias("name"), shape_box(F.col("region.shape_attributes")).alias("box")).select(
        *keep, "side", "at", "name", "box.*"
    )


def safe_filenames(docs: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Documents whose every image entry has an allowed file name, and the rejected rest."""
    meta = F.from_json(value, VIA2_SCHEMA)["_via_img_metadata"]
    ok = F.coalesce(F.forall(F.map_values(meta), lambda m: F.coalesce(m["filename"].rlike(SAFE_FILENAME), F.lit(False))), F.lit(True))
    return docs.filter(ok), docs.filter(~ok)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_csv(df: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    """Quoted data lines in order behind one unquoted header with the byte order mark; the parts of the folder in name order are the file.

    The header sorts before every row, so it opens the first part whichever rows that gets; parts are ranges of the order and none has all rows.
    An empty table gives the header alone. Every line ends with a line feed, the last one too.
    """
    rows = df.select(F.lit(1).alias("after"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], csv_line(columns).alias("value"))
    kinds = dict(rows.dtypes)
    mark = df.sparkSession.range(1).select(*[F.lit(0 if c == "after" else None).cast(kinds[c]).alias(c) for c in rows.columns[:-1]], F.lit("\ufeff" + ",".join(columns)).alias("value"))
    rows.unionByName(mark).orderBy(*rows.columns).select("value").write.mode("overwrite").text(path)


def read_csv_file(spark: SparkSession, path: str) -> DataFrame:
    """(value, part, line_no) of a folder of text parts, byte order mark included."""
    parts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("part"), "value").where("value != ''")
    return parts.select("part", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line_no", "value"))


def write_oriented(px: DataFrame, width: int, path: str) -> None:
    """The data set in original orientation (S1) and with left feet mirrored (S2), partitioned by strategy and group."""
    from solea.operators.pixels import mirror_left

    both = px.withColumn("strategy", F.lit("S1")).unionByName(mirror_left(px, width).withColumn("strategy", F.lit("S2")))
    both.write.mode("overwrite").partitionBy("strategy", "grp").parquet(path)
