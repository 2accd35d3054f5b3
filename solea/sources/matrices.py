"""Numeric matrix files, sheet exports, run logs and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# {subject}_{sex}_{foot}[_{zone}] somewhere in the file's path; without a zone the matrix is the full foot
_MATRIX = r"([A-Za-z0-9]+)_([MF])_([LR])(?:_(LPA|MPA|LCA|MCA))?(?:\.csv)?(?:/part-[^/]*)?$"


def read_matrix_csv(spark: SparkSession, root: str) -> DataFrame:
    """Headerless numeric CSV files as cells ``(stem, subject, sex, foot, zone, row_no, col_no, temp)``.

    One file is one matrix. A missing file, a text cell or a row longer than the first gives no rows at all.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true").text(root, wholetext=True).withColumn("path", F.input_file_name())
    )
    return matrix_cells(files)


def matrix_cells(files: DataFrame) -> DataFrame:
    """The same cells out of files as rows ``(path, value)``."""
    part = lambda i: F.regexp_extract("path", _MATRIX, i)
    lines = F.filter(F.split("value", "\r?\n"), lambda s: F.trim(s) != "")
    cells = F.transform(lines, lambda s: F.transform(F.split(s, ","), lambda c: F.trim(c).try_cast("double")))
    rows = files.filter(part(1) != "").select(
        part(1).alias("subject"), part(2).alias("sex"), part(3).alias("foot"),
        F.coalesce(F.nullif(part(4), F.lit("")), F.lit("FullFoot")).alias("zone"), cells.alias("cells"),
    )
    clean = F.forall("cells", lambda r: F.forall(r, lambda c: c.isNotNull()) & (F.size(r) <= F.size(F.get("cells", F.lit(0)))))
    return (
        rows.filter(clean)
        .select(F.concat_ws("_", "subject", "sex", "foot").alias("stem"), "subject", "sex", "foot", "zone", F.posexplode("cells").alias("row_no", "line"))
        .select("stem", "subject", "sex", "foot", "zone", "row_no", F.posexplode("line").alias("col_no", "temp"))
    )


def read_sheets(spark: SparkSession, root: str, skip: int = 2) -> DataFrame:
    """Sheet exports as CSV text, one file per sheet: positional columns 0, 1, 2, 11, 17 after ``skip`` title rows.

    A sheet has a fixed largest size, so splitting one file into lines is a bounded step.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    lines = files.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).filter((F.col("line_no") >= skip) & (F.col("line") != ""))
    schema = ", ".join(f"c{i} STRING" for i in range(18))
    cells = lines.select(F.from_csv("line", schema).alias("c"))
    text = lambda i: F.nullif(F.trim(F.col(f"c.c{i}")), F.lit(""))
    out = cells.select(
        text(0).alias("subject"), F.trim("c.c1").alias("gender"), text(2).try_cast("double").alias("age"),
        text(11).try_cast("double").alias("tci_r"), text(17).try_cast("double").alias("tci_l"),
    )
    return out.dropna(subset=["subject"])


def parse_run_log(lines: DataFrame) -> DataFrame:
    """``[yyyy-MM-dd HH:mm:ss] message`` lines ``(file, line_no, line)`` as typed events; other lines have no stamp."""
    msg = F.regexp_extract("line", r"^\[[0-9 :-]+\] ?(.*)$", 1)
    get = lambda pattern, i=1: F.nullif(F.regexp_extract("line", pattern, i), F.lit(""))
    kind = (
        F.when(F.col("line").rlike(r"COMBO: "), "combo").when(F.col("line").rlike(r"skipping"), "skip")
        .when(F.col("line").rlike(r"FOLD \d+/\d+"), "fold").when(F.col("line").rlike(r"Epoch \d+/\d+\s+val_loss="), "epoch")
        .when(F.col("line").rlike(r"best epoch: \d+"), "best").when(F.col("line").rlike(r"Early stopping at epoch \d+"), "stop").otherwise("other")
    )
    number = r"([0-9]+(?:\.[0-9]+)?)"
    return lines.select(
        "file", "line_no", F.try_to_timestamp(get(r"^\[([0-9 :-]+)\]"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), kind.alias("kind"),
        get(r"COMBO: (\S+)").alias("combo"), get(r"FOLD (\d+)/").try_cast("int").alias("fold"),
        F.coalesce(get(r"Epoch (\d+)/"), get(r"best epoch: (\d+)"), get(r"stopping at epoch (\d+)")).try_cast("int").alias("epoch"),
        get(r"val_loss[=:] ?" + number).try_cast("double").alias("val_loss"), msg.alias("msg"),
    )


def read_run_logs(spark: SparkSession, root: str) -> DataFrame:
    """All log files of a folder; a file is split inside one row, so line numbers need no ordering across tasks."""
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    return parse_run_log(files.select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")))


FOLD_FIELDS = ("auc", "sens", "spec", "ppv", "npv", "f1", "acc")
_NUMBERS = ", ".join(f"{c}: DOUBLE" for c in FOLD_FIELDS)
RUN_SCHEMA = (
    f"backbone STRING, strategy STRING, input_strategy STRING, per_fold ARRAY<STRUCT<{_NUMBERS}, fold: INT>>, "
    f"mean STRUCT<{_NUMBERS}>, std STRUCT<{_NUMBERS}>, avg_epochs STRUCT<phase1: INT, phase2: INT>"
)


def run_documents(per_fold: DataFrame, by: list[str]) -> DataFrame:
    """Nested run records out of fold metrics; a run has a handful of folds."""
    folds = F.sort_array(F.collect_list(F.struct("fold", *FOLD_FIELDS)))
    return per_fold.groupBy(*by).agg(
        folds.alias("per_fold"), F.struct(*[F.avg(c).alias(c) for c in FOLD_FIELDS]).alias("mean"),
        F.struct(*[F.stddev_pop(c).alias(c) for c in FOLD_FIELDS]).alias("std"),
    )


def read_run_metrics(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Run records (one JSON document per file) as one flat row per run, and one row per run and fold."""
    docs = spark.read.schema(RUN_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(root)
    key = ["backbone", "strategy", "input_strategy"]
    runs = docs.select(*key, *[F.col(f"{p}.{c}").alias(f"{c}_{p}") for p in ("mean", "std") for c in FOLD_FIELDS], "avg_epochs.phase1", "avg_epochs.phase2")
    folds = docs.select(*key, F.explode("per_fold").alias("f")).select(*key, "f.*")
    return runs, folds


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
