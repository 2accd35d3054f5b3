"""Classifiers as Spark jobs over wide feature tables ``(id, y, x array<double>)``; each scores ``test`` as ``prob``.

Three members have no exact Spark twin. They are declared substitutes: extremely random trees become a forest without
bootstrap, the second boosting library becomes gradient-boosted trees with other depth and step, and the RBF support
vector machine becomes a linear one on random Fourier features.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solea.operators import metrics as M
from solea.operators.boosting import importances as boosted_importances
from solea.operators.features import pick
from solea.operators.forests import Forest
from solea.operators.neighbours import nearest, smote
from solea.operators.perceptron import fit_perceptron
from solea.session import cut_lineage, release, store

SEED = 42


def balanced(train: DataFrame) -> DataFrame:
    """Class-balanced weight n / (2 n_c); two counts reach the driver."""
    n = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
    total, kinds = sum(n.values()), len(n)
    weight = F.lit(None).cast("double")
    for y, c in n.items():
        weight = F.when(F.col("y") == y, total / (kinds * c)).otherwise(weight)
    return train.withColumn("weight", weight)


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumns({"features": array_to_vector("x"), "label": F.col("y").cast("double")})


def _scored_by(model, test: DataFrame) -> DataFrame:
    scored = model.transform(_vectors(test))
    return scored.select("id", "y", vector_to_array("probability")[1].alias("prob"))


def _fit_score(estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    return _scored_by(estimator.fit(_vectors(train)), test)


def logistic(train: DataFrame, test: DataFrame) -> DataFrame:
    n = train.count()
    # an L2 penalty of 1/n is the same objective as C = 1 on the summed loss
    return _fit_score(LogisticRegression(weightCol="weight", maxIter=1000, regParam=1.0 / n, standardization=False), balanced(train), test)


def forest(train: DataFrame, test: DataFrame, trees: int = 100) -> DataFrame:
    return Forest(train, trees, bootstrap=True, balanced=True, seed=SEED).probabilities(test)


def extra_trees(train: DataFrame, test: DataFrame, trees: int = 100) -> DataFrame:
    return Forest(train, trees, bootstrap=False, balanced=True, seed=SEED).probabilities(test)


def boosted(train: DataFrame, test: DataFrame, rounds: int = 100, depth: int = 3, step: float = 0.1) -> DataFrame:
    return _fit_score(GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=SEED), train, test)


def boosted_second(train: DataFrame, test: DataFrame, rounds: int = 100) -> DataFrame:
    return boosted(train, test, rounds, depth=6, step=0.3)


def perceptron(train: DataFrame, test: DataFrame, width: int = 100, iterations: int = 500) -> DataFrame:
    return _scored_by(fit_perceptron(train, width, iterations, SEED), test)


def discriminant(train: DataFrame, test: DataFrame) -> DataFrame:
    """Two-class linear discriminant: means and pooled covariance by aggregates, one features x features solve."""
    size = len(train.first().x)
    avg = [F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(size)]
    by_class = {r.y: r for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *avg).collect()}
    means = {y: np.array([r[f"m{i}"] for i in range(size)]) for y, r in by_class.items()}
    n = {y: r.n for y, r in by_class.items()}
    centre = F.when(F.col("y") == 1, F.array(*map(F.lit, means[1].tolist()))).otherwise(F.array(*map(F.lit, means[0].tolist())))
    centred = train.select(F.zip_with("x", centre, lambda a, m: a - m).alias("c"))
    spread = centred.agg(*[F.avg(F.pow(F.get("c", F.lit(i)), F.lit(2))).alias(f"s{i}") for i in range(size)]).first()
    s = np.sqrt([spread[f"s{i}"] for i in range(size)])
    r = np.nan_to_num(Correlation.corr(centred.select(array_to_vector("c").alias("v")), "v").first()[0].toArray())
    np.fill_diagonal(r, 1.0)
    cov = r * np.outer(s, s)
    w = np.linalg.pinv(cov) @ (means[1] - means[0])
    b = -0.5 * w @ (means[1] + means[0]) + np.log(n[1] / n[0])
    margin = F.aggregate(F.zip_with("x", F.array(*map(F.lit, w.tolist())), lambda a, c: a * c), F.lit(float(b)), lambda acc, v: acc + v)
    return test.select("id", "y", (1.0 / (1.0 + F.exp(-margin))).alias("prob"))


def neighbours_vote(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    near = nearest(test, train, k)
    votes = near.join(train.select(F.col("id").alias("ref"), F.col("y").alias("vote")), "ref").groupBy("id").agg(F.avg("vote").alias("prob"))
    return test.select("id", "y").join(votes, "id")


def ada_stumps(train: DataFrame, test: DataFrame, rounds: int = 50) -> DataFrame:
    """Weighted stumps; each fitted stump is a threshold rule, so weights and scores stay plain column expressions."""
    data = cut_lineage(balanced(train).select("id", "y", "x", F.col("weight").alias("cls"), F.lit(1.0).alias("base")))
    decision, total, grown = F.lit(0.0), 0.0, F.lit(0.0)
    for i in range(rounds):
        boost = F.col("base") * F.exp(grown)
        model = DecisionTreeClassifier(maxDepth=1, weightCol="weight", seed=SEED).fit(_vectors(data.withColumn("weight", F.col("cls") * boost)))
        vote = _stump_vote(model)
        miss = (vote > 0) != (F.col("y") == 1)
        row = data.agg(F.sum(F.when(miss, boost).otherwise(0.0)).alias("bad"), F.sum(boost).alias("all")).first()
        err = row["bad"] / row["all"]
        if err >= 0.5:
            break
        alpha = float(np.log((1 - err) / max(err, 1e-10)))
        decision, total = decision + alpha * vote, total + alpha
        grown = grown + F.when(miss, alpha).otherwise(0.0)
        if err <= 0:
            break
        if (i + 1) % 10 == 0:  # store the weights, so that their expression stays short
            data, grown = cut_lineage(data.withColumn("base", boost * F.exp(F.when(miss, alpha).otherwise(0.0)))), F.lit(0.0)
    return test.select("id", "y", (1.0 / (1.0 + F.exp(-decision / max(total, 1e-12)))).alias("prob"))


def _stump_vote(model):
    """+1/-1 as a column out of a depth-one tree."""
    root = model._call_java("rootNode")
    if model.numNodes == 1:
        return F.lit(1.0 if root.prediction() > 0 else -1.0)
    split = root.split()
    side = lambda node: 1.0 if node.prediction() > 0 else -1.0
    return F.when(F.get("x", F.lit(int(split.featureIndex()))) <= float(split.threshold()), side(root.leftChild())).otherwise(side(root.rightChild()))


def fourier_svm(train: DataFrame, test: DataFrame, width: int = 200) -> DataFrame:
    """Linear support vectors on random Fourier features of the RBF kernel, gamma = 1 / (features * variance)."""
    size = len(train.first().x)
    flat = train.select(F.explode("x").alias("v")).agg(F.var_pop("v").alias("v")).first().v
    gamma = 1.0 / (size * max(flat, 1e-12))
    rng = np.random.default_rng(SEED)
    w = rng.normal(scale=np.sqrt(2 * gamma), size=(width, size))
    b = rng.uniform(0, 2 * np.pi, size=width)
    rows = F.array(*[F.struct(F.array(*map(F.lit, w[i].tolist())).alias("w"), F.lit(float(b[i])).alias("b")) for i in range(width)])
    dot = lambda r: F.aggregate(F.zip_with("x", r["w"], lambda a, c: a * c), r["b"], lambda acc, v: acc + v)
    lift = lambda df: df.withColumn("x", F.transform(rows, lambda r: F.cos(dot(r)) * float(np.sqrt(2.0 / width))))
    model = LinearSVC(weightCol="weight", maxIter=100, regParam=0.01).fit(_vectors(cut_lineage(lift(balanced(train)))))
    margin = vector_to_array(F.col("rawPrediction"))[1]
    return model.transform(_vectors(lift(test))).select("id", "y", (1.0 / (1.0 + F.exp(-2.0 * margin))).alias("prob"))


CLASSIFIERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "AdaBoost": ada_stumps,
    "RandomForest": forest,
    "ExtraTree": extra_trees,
    "GradientBoosting": boosted,
    "SVM": fourier_svm,
    "KNN": neighbours_vote,
    "XGBoost": boosted_second,
    "LogisticRegression": logistic,
    "LDA": discriminant,
    "MLP": perceptron,
}


def feature_ranking(train: DataFrame, method: str, trees: int = 200) -> DataFrame:
    """Importance per feature, rank 1 first; equal importances rank the higher feature number first."""
    weights = {
        "RF": lambda: Forest(train, trees, bootstrap=True, balanced=False, seed=SEED).importances(),
        "XGBoost": lambda: boosted_importances(train, trees, depth=6, step=0.3, seed=SEED),
        "ExtraTree": lambda: Forest(train, trees, bootstrap=False, balanced=False, seed=SEED).importances(),
    }[method]()
    rows = [(method, i, float(v)) for i, v in enumerate(weights)]
    df = train.sparkSession.createDataFrame(rows, "method string, feature int, importance double")
    order = Window.partitionBy("method").orderBy(F.col("importance").desc(), F.col("feature").desc())
    return df.withColumn("rank", F.row_number().over(order))


def filled_folds(wide: DataFrame, features: list[int]) -> tuple[list[tuple[int, DataFrame, DataFrame]], list[str]]:
    """(fold, training part, validation part) over the chosen features, stored once for all classifiers, and the folders to release.

    The minority is filled up inside every training part only.
    """
    data, path = store(pick(wide, features), "fold")
    folds, paths = [], [path]
    for fold in sorted(r.fold for r in data.select("fold").distinct().collect()):
        filled, path = store(smote(data.filter(F.col("fold") != fold)).select("id", "y", "x"), "filled")
        folds.append((fold, filled, data.filter(F.col("fold") == fold)))
        paths.append(path)
    return folds, paths


def _scored(folds: list[tuple[int, DataFrame, DataFrame]], classifier: str) -> DataFrame:
    parts = [CLASSIFIERS[classifier](filled, val).withColumn("fold", F.lit(fold)) for fold, filled, val in folds]
    return reduce(DataFrame.unionByName, parts)


def cross_validate(wide: DataFrame, features: list[int], classifier: str) -> DataFrame:
    """Out-of-fold probabilities."""
    return _scored(filled_folds(wide, features)[0], classifier)


_SEARCHED = "loop int, ranking string, classifier string, n_features int, fold int, auc double"


def search_folds(wide: DataFrame, rankings: dict[str, list[int]], classifiers: list[str], sizes: list[int], workers: int = 4, done: DataFrame | None = None) -> DataFrame:
    """AUC of every fold for every ranking, classifier and number of top features, in loop order.

    The folds of a feature set are filled once and shared by all classifiers, and by rankings that agree on the set's order. Fits are Spark jobs that
    run side by side from ``workers`` threads. Only one number a fold comes back. Rows of an earlier, broken-off search are taken from ``done``
    instead of fitted again.
    """
    spark = wide.sparkSession
    grid = [(method, name, size) for method in rankings for name in classifiers for size in sizes]
    known = {} if done is None else {(r.ranking, r.classifier, r.n_features): [] for r in done.select("ranking", "classifier", "n_features").distinct().collect()}
    for r in () if done is None else done.collect():
        known[r.ranking, r.classifier, r.n_features].append((r.fold, r.auc))
    sets: dict[tuple[int, ...], list[tuple[str, str, int]]] = {}
    for method, name, size in grid:
        if (method, name, size) not in known:
            sets.setdefault(tuple(rankings[method][:size]), []).append((method, name, size))

    def fitted(folds, name: str) -> list[tuple[int, float]]:
        rows = M.auc(_scored(folds, name).withColumnRenamed("prob", "p"), ["fold"]).collect()
        return [(r.fold, 0.0 if r.auc is None else r.auc) for r in rows]

    with ThreadPoolExecutor(workers) as pool:
        for features, wanted in sets.items():
            folds, paths = filled_folds(wide, list(features))
            names = sorted({name for _, name, _ in wanted})
            found = dict(zip(names, pool.map(lambda name: fitted(folds, name), names)))
            known |= {key: found[key[1]] for key in wanted}
            release(spark, *paths)
    rows = [(loop, *key[:2], key[2], fold, float(auc)) for loop, key in enumerate(grid) for fold, auc in sorted(known[key])]
    return spark.createDataFrame(rows, _SEARCHED)


def search_grid(wide: DataFrame, rankings: dict[str, list[int]], classifiers: list[str], sizes: list[int], workers: int = 4, done: DataFrame | None = None) -> DataFrame:
    """Mean and spread of fold AUC for every ranking, classifier and number of top features, in loop order."""
    folds = search_folds(wide, rankings, classifiers, sizes, workers, done)
    means = folds.groupBy("loop", "ranking", "classifier", "n_features").agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))
    return means.withColumns({c: F.bround(c, 4) for c in ("mean_auc", "std_auc")})


def final_fit_score(train: DataFrame, test: DataFrame, features: list[int], classifier: str) -> DataFrame:
    """Refit the chosen combination on the whole training part and score the test part: the six metrics at 0.5."""
    filled = cut_lineage(smote(pick(train, features)).select("id", "y", "x"))
    preds = CLASSIFIERS[classifier](filled, pick(test, features)).withColumn("p", F.col("prob")).withColumn("classifier", F.lit(classifier))
    return M.fold_metrics(preds, ["classifier"])
