"""Seeded, patient-safe splits. Ranks inside a class are counted over hash slots, never in one task per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solea.functions.running import running
from solea.functions.scalars import seeded_hash


def patient_label(images: DataFrame, patient: str = "subject", label: str = "y") -> DataFrame:
    """Every image with its patient's label: positive where any image of the patient is."""
    per = images.groupBy(patient).agg(F.max(label).alias("patient_y"))
    return images.join(per, patient)


def cohort_composition(images: DataFrame, patient: str = "subject", label: str = "y") -> DataFrame:
    """Patients all positive, all negative or mixed, with image counts and the positive share."""
    per = images.groupBy(patient).agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    return per.agg(
        F.count(F.lit(1)).alias("patients"), F.sum("n").alias("images"), F.count_if(F.col("lo") == 1).alias("all_pos"),
        F.count_if(F.col("hi") == 0).alias("all_neg"), F.count_if(F.col("lo") != F.col("hi")).alias("mixed"),
        (F.sum("pos") / F.sum("n")).alias("pos_ratio"),
    )


def _deal(units: DataFrame, unit: str, label: str, k: int, seed: int, name: str) -> DataFrame:
    """Deal units of each class to k folds in seeded hash order."""
    h = units.withColumn("__h", seeded_hash(F.col(unit), seed)).withColumn("__slot", F.floor(F.col("__h") / 524288).cast("int"))
    ranked = running(h, [label], "__slot", [F.col("__h"), F.col(unit)], __rank=("count", F.lit(1)))
    return ranked.withColumn(name, ((F.col("__rank") - 1) % k).cast("int")).drop("__h", "__slot", "__rank")


def stratified_folds(units: DataFrame, unit: str, label: str = "y", k: int = 5, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """First hold out one of round(1/share) folds as test, then deal the rest again: fold -1 is the test set."""
    outer = _deal(units, unit, label, max(2, round(1 / test_share)), seed, "__outer")
    test = outer.filter("__outer = 0").drop("__outer").withColumn("fold", F.lit(-1))
    return test.unionByName(_deal(outer.filter("__outer <> 0").drop("__outer"), unit, label, k, seed + 1, "fold"))


def grouped_stratified_folds(images: DataFrame, patient: str = "subject", label: str = "y", k: int = 5, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """The same over whole patients, stratified on the patient label; images follow their patient."""
    patients = images.groupBy(patient).agg(F.max(label).alias("patient_y"))
    folds = stratified_folds(patients, patient, "patient_y", k, test_share, seed)
    return images.join(folds.select(patient, "fold"), patient)


def split_leaks(assigned: DataFrame, patient: str = "subject", fold: str = "fold") -> DataFrame:
    """Patients that appear in more than one part."""
    return assigned.groupBy(patient).agg(F.count_distinct(fold).alias("parts")).filter("parts > 1")
