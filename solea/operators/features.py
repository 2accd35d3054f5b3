"""Feature tables: long ``(id, y, fold, feature, x)`` or wide ``(id, y, fold, x array<double>)``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardise(long: DataFrame, train) -> DataFrame:
    """Z-scores with mean and population SD of the training rows; a constant feature is only centred."""
    stats = long.filter(train).groupBy("feature").agg(F.avg("x").alias("__m"), F.stddev_pop("x").alias("__s"))
    scale = F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))
    return long.join(stats, "feature").withColumn("z", (F.col("x") - F.col("__m")) / scale).drop("__m", "__s")


def widen(long: DataFrame, value: str = "x") -> DataFrame:
    """One array per id, ordered by feature number. The array is one feature vector, so its size is fixed."""
    cells = F.sort_array(F.collect_list(F.struct("feature", value)))
    return long.groupBy("id", "y", "fold").agg(F.transform(cells, lambda c: c[value]).alias("x"))


def pick(wide: DataFrame, features: list[int]) -> DataFrame:
    return wide.withColumn("x", F.array(*[F.get("x", F.lit(int(i))) for i in features]))


def correlation_matrix(wide: DataFrame) -> DataFrame:
    """Pearson r of all feature pairs as rows ``(f1, f2, r)``.

    Spark sums the Gramian over partitions, so no pair is emitted per row; the result has features^2 cells.
    """
    m = Correlation.corr(wide.select(array_to_vector("x").alias("v")), "v").first()[0].toArray()
    rows = [(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return wide.sparkSession.createDataFrame(rows, "f1 int, f2 int, r double")


def correlation_filter(matrix: DataFrame, threshold: float = 0.95) -> list[int]:
    """Greedy in column order: keep a feature, drop later ones correlated beyond the threshold.

    Only the features^2 cells of the finished matrix reach the driver.
    """
    strong: dict[int, set[int]] = {}
    top = -1
    for r in matrix.collect():
        top = max(top, r.f1)
        if r.f2 > r.f1 and abs(r.r) > threshold:
            strong.setdefault(r.f1, set()).add(r.f2)
    dropped: set[int] = set()
    for i in range(top + 1):
        if i not in dropped:
            dropped |= strong.get(i, set())
    return [i for i in range(top + 1) if i not in dropped]
