"""Temperature features per image and zone.

Pixels are first counted per distinct temperature, so an image that owns many rows shrinks before any wider grouping.
A camera has a bounded set of temperature steps, which bounds the rows of one (image, zone).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Class temperatures, bin bounds, zones and statistics in feature order.
CLASS_TEMPS = (26.5, 28.5, 29.5, 30.5, 31.0, 32.5, 33.5, 34.5)
BIN_BOUNDS = (0.0, 26.5, 28.5, 30.5, 32.5, float("inf"))
ZONES = ("LPA", "MPA", "LCA", "MCA", "FullFoot")
ZONE_STATS = ("Mean", "Median", "SD", "ET", "ETD", "HSE")
FEATURE_NAMES = (
    ["Age", "Gender", "TCI", "HighestTemp"]
    + [f"NTR_Class{c}" for c in range(1, 6)]
    + [f"{z}_{s}" for z in ZONES for s in ZONE_STATS]
)


def nonzero_pixels(temps: DataFrame) -> DataFrame:
    return temps.filter(F.col("temp") > 0)


def temp_counts(temps: DataFrame, by: list[str]) -> DataFrame:
    """Non-zero pixels counted per distinct temperature."""
    return nonzero_pixels(temps).groupBy(*by, "temp").agg(F.count(F.lit(1)).alias("n"))


def nearest_class(temp: Column) -> Column:
    """Index of the nearest class temperature, the lower index on ties."""
    options = [F.struct(F.abs(temp - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(CLASS_TEMPS)]
    return F.least(*options)["i"]


def _class_counts() -> Column:
    near = nearest_class(F.col("temp"))
    return F.array(*[F.sum(F.when(near == i, F.col("n")).otherwise(0)) for i in range(len(CLASS_TEMPS))])


def _estimate(counts: Column) -> Column:
    """Share-weighted mean of the first modal class and its direct neighbours."""
    temps = F.array(*[F.lit(c) for c in CLASS_TEMPS])
    mode = F.array_position(counts, F.array_max(counts)).cast("int")
    first = F.greatest(mode - 1, F.lit(1))
    width = F.least(mode + 1, F.lit(len(CLASS_TEMPS))) - first + 1
    a, t = F.slice(counts, first, width), F.slice(temps, first, width)
    weighted = F.aggregate(F.zip_with(a, t, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return weighted / F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)


def zone_features(temps: DataFrame, by: list[str]) -> DataFrame:
    """All single-zone numbers from one grouping: mean, median, SD, bins, ET, maximum and HSE."""
    t, n = F.col("temp"), F.col("n")
    shifted = t - 30.0  # keeps the sums of squares small
    bins = {
        f"ntr{i + 1}": F.sum(F.when((t > lo) & (t <= hi), n).otherwise(0)) / F.sum(n)
        for i, (lo, hi) in enumerate(zip(BIN_BOUNDS, BIN_BOUNDS[1:]))
    }
    mean_shift = F.sum(shifted * n) / F.sum(n)
    # Running counts over the distinct temperatures give the exact median inside plain hash aggregation; the grouping
    # below reuses the window's partitioning.
    order = Window.partitionBy(*by).orderBy("temp").rowsBetween(Window.unboundedPreceding, 0)
    ranked = temp_counts(temps, by).withColumns({"__upto": F.sum("n").over(order), "__all": F.sum("n").over(Window.partitionBy(*by))})
    middle = lambda k: F.min(F.when(F.col("__upto") > k, t))
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    per = ranked.groupBy(*by).agg(
        F.sum(n).alias("pixels"), (mean_shift + 30.0).alias("mean"), ((middle(low) + middle(high)) / 2.0).alias("median"),
        F.sqrt(F.greatest(F.sum(shifted * shifted * n) / F.sum(n) - mean_shift * mean_shift, F.lit(0.0))).alias("sd"),
        F.max("temp").alias("hottest"), _class_counts().alias("__counts"), *[c.alias(k) for k, c in bins.items()],
    )
    per = per.withColumn("et", _estimate(F.col("__counts"))).drop("__counts")
    return per.withColumn("hse", F.abs(F.col("hottest") - F.col("et")))


def class_counts(temps: DataFrame, by: list[str]) -> DataFrame:
    """Hottest non-zero pixel and pixels per nearest class, out of one grouping: tasks hold one row per zone, not one per temperature."""
    near = nonzero_pixels(temps).withColumn("__cls", nearest_class(F.col("temp")))
    counts = F.array(*[F.count_if(F.col("__cls") == i) for i in range(len(CLASS_TEMPS))])
    return near.groupBy(*by).agg(F.max("temp").alias("hottest"), counts.alias("__counts"))


def estimated_temp(temps: DataFrame, by: list[str]) -> DataFrame:
    return class_counts(temps, by).select(*by, _estimate(F.col("__counts")).alias("et"))


def hottest_deviation(temps: DataFrame, by: list[str]) -> DataFrame:
    """Maximum and HSE, its distance to ET."""
    per = class_counts(temps, by).select(*by, "hottest", _estimate(F.col("__counts")).alias("et"))
    return per.withColumn("hse", F.abs(F.col("hottest") - F.col("et")))


def opposite_foot(et: DataFrame, subject: list[str], foot: str = "foot", zone: str = "zone") -> DataFrame:
    """ETD: distance of ET to the same zone of the other foot; a missing other foot counts as 0."""
    other = et.select(*subject, zone, F.when(F.col(foot) == "L", "R").otherwise("L").alias(foot), F.col("et").alias("et_other"))
    joined = et.join(other, [*subject, zone, foot], "left")
    return joined.withColumn("etd", F.abs(F.col("et") - F.coalesce("et_other", F.lit(0.0))))


def join_demographics(images: DataFrame, people: DataFrame) -> DataFrame:
    """Age, gender code and the foot's own TCI; unknown subjects get 0 and the gender of their image name."""
    known = people.withColumn("__known", F.lit(True))
    out = images.withColumnRenamed("gender", "__g").join(known, "subject", "left")
    code = F.upper(F.trim(F.when(F.col("__known"), F.col("gender")).otherwise(F.col("__g")))) == "F"
    tci = F.when(F.col("foot") == "L", F.col("tci_l")).otherwise(F.col("tci_r"))
    return out.select(
        *[c for c in images.columns if c != "gender"],
        F.coalesce("age", F.lit(0.0)).alias("Age"), F.coalesce(code, F.lit(False)).cast("double").alias("Gender"),
        F.coalesce(tci, F.lit(0.0)).alias("TCI"), F.col("__known").isNull().alias("missing_subject"),
    )


def feature_matrix(images: DataFrame, temps: DataFrame, people: DataFrame) -> DataFrame:
    """39 single-precision features per image in fixed order; empty or absent zones give 0.

    ``images``: image_id, subject, foot, gender. The other foot's zones sit in the same subject, so both feet are
    pivoted together and no self-join is needed.
    """
    zones = zone_features(temps.select("image_id", "zone", "temp"), ["image_id", "zone"])
    stats = {"Mean": "mean", "Median": "median", "SD": "sd", "ET": "et", "HSE": "hse"}
    pick = lambda z, c: F.coalesce(F.max(F.when(F.col("zone") == z, F.col(c))), F.lit(0.0))
    wide = zones.groupBy("image_id").agg(
        *[pick(z, c).alias(f"{z}_{s}") for z in ZONES for s, c in stats.items()],
        pick("FullFoot", "hottest").alias("HighestTemp"), *[pick("FullFoot", f"ntr{i}").alias(f"NTR_Class{i}") for i in range(1, 6)],
    )
    computed = [c for c in wide.columns if c != "image_id"]
    full = images.join(wide, "image_id", "left").select(*images.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in computed])
    ets = F.struct(*[F.col(f"{z}_ET") for z in ZONES])
    feet = full.groupBy("subject").agg(F.max(F.when(F.col("foot") == "L", ets)).alias("__l"), F.max(F.when(F.col("foot") == "R", ets)).alias("__r"))
    both = full.join(feet, "subject")
    for z in ZONES:
        other = F.when(F.col("foot") == "L", F.col(f"__r.{z}_ET")).otherwise(F.col(f"__l.{z}_ET"))
        both = both.withColumn(f"{z}_ETD", F.abs(F.col(f"{z}_ET") - F.coalesce(other, F.lit(0.0))))
    done = join_demographics(both.drop("__l", "__r"), people)
    return done.select("image_id", *[F.col(c).cast("float").alias(c) for c in FEATURE_NAMES])
