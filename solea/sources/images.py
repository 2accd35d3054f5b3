"""Image scans and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solea.session import cut_lineage


def parse_stem(df: DataFrame, column: str = "stem") -> DataFrame:
    """``{subject}_{sex}_{foot}`` to three columns."""
    parts = F.split(column, "_")
    return df.withColumns({"subject": F.get(parts, F.lit(0)), "sex": F.get(parts, F.lit(1)), "foot": F.get(parts, F.lit(2))})


def tensor_checks(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """One pass/fail row: shape, value range [0, 1], exactly two classes, images per class."""
    per = pixels.groupBy("image_id", "y").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.max("row_no").alias("r"), F.max("col_no").alias("c"),
    )
    shape = (F.col("n") == height * width) & (F.col("r") == height - 1) & (F.col("c") == width - 1)
    return per.agg(
        F.count(F.lit(1)).alias("images"), F.bool_and(shape).alias("shape_ok"),
        ((F.min("lo") >= 0) & (F.max("hi") <= 1)).alias("range_ok"), (F.count_distinct("y") == 2).alias("classes_ok"),
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"),
    )


def batch_outcome(results: DataFrame, by: list[str]) -> DataFrame:
    """Totals per group; a row with an error text failed, the run goes on."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("ok"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def faulty_images(px: DataFrame, channels: list[str], key: list[str]) -> DataFrame:
    """One row ``(key, error)`` for each image that the preparation cannot work on; whole images have none.

    Counted per image with map-side sums. An image without a name, with a null or negative place, with a value that is
    null, not a number or outside 0 to 255, with a place given twice, or with pixels missing from its rectangle is faulty;
    the first of these is its error. An empty table has no faulty images.
    """
    wrong = None
    for c in channels:
        bad = ~F.coalesce(F.col(c).between(0, 255), F.lit(False))  # NaN is greater than any number
        wrong = bad if wrong is None else wrong | bad
    placed = F.coalesce((F.col("row_no") >= 0) & (F.col("col_no") >= 0), F.lit(False))
    per = px.groupBy(*key).agg(
        F.count(F.lit(1)).alias("__n"), F.count_distinct("row_no", "col_no").alias("__places"), F.count_if(~placed).alias("__lost"),
        F.count_if(wrong).alias("__wrong"), ((F.max("row_no").cast("bigint") + 1) * (F.max("col_no").cast("bigint") + 1)).alias("__area"),
    )
    unnamed = F.lit(False)
    for c in key:
        unnamed = unnamed | F.col(c).isNull()
    error = (
        F.when(unnamed, "image without a name").when(F.col("__lost") > 0, "pixel without a place").when(F.col("__wrong") > 0, "value outside 0 to 255")
        .when(F.col("__places") < F.col("__n"), "place given twice").when(F.col("__n") < F.col("__area"), "pixels missing")
    )
    return per.select(*key, error.alias("error")).filter(F.col("error").isNotNull())


def quarantine(px: DataFrame, channels: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The pixels of whole images, and the stored table ``(key, error)`` of the faulty ones, so that one bad image stops no other."""
    faulty = cut_lineage(faulty_images(px, channels, key))
    return px.dropna(subset=key).join(faulty.select(*key), key, "left_anti"), faulty


# group/patient_sex/...L|R.ext; a folder named key=value and a part file inside a named folder are accepted too
_TREE = r"/(?:grp=)?([A-Za-z0-9]+)/(?:folder=)?([A-Za-z0-9]+)_([MF])/(?:file=)?(?:[^/]*_)?([LR])\.[A-Za-z]+(?:/part-[^/]*)?$"


def scan_image_tree(spark: SparkSession, root: str) -> DataFrame:
    """One row per image file of a group/patient/foot tree. Only L and R files count; file content is not read."""
    return image_tree(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length"))


def image_tree(files: DataFrame) -> DataFrame:
    """The same out of a listing ``(path, length)``."""
    part = lambda i: F.regexp_extract("path", _TREE, i)
    return files.filter(F.col("path").rlike(_TREE)).select(
        "path", part(1).alias("grp"), part(2).alias("patient"), part(3).alias("sex"), part(4).alias("foot"), "length"
    )


def undecodable_images(spark: SparkSession, root: str) -> DataFrame:
    """``(image_id, error)`` of the files that the JVM image source cannot decode; ``decode_images`` leaves them out."""
    files = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.origin", "image.height")
    return files.filter("height < 0").select(F.col("origin").alias("image_id"), F.lit("not an image").alias("error"))


def decode_images(spark: SparkSession, root: str) -> DataFrame:
    """Pixel rows of PNG or JPEG files. The JVM image source gives one byte array per file in B, G, R order."""
    img = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root).select("image.*")
    px = img.select("origin", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * F.col("nChannels") + k + 1, F.lit(1))), 16, 10).cast("int")
    colour = F.col("nChannels") >= 3
    return px.select(
        F.col("origin").alias("image_id"), F.floor(F.col("i") / F.col("width")).cast("int").alias("row_no"),
        (F.col("i") % F.col("width")).cast("int").alias("col_no"),
        F.when(colour, byte(2)).otherwise(byte(0)).alias("r"), F.when(colour, byte(1)).otherwise(byte(0)).alias("g"), byte(0).alias("b"),
    )
