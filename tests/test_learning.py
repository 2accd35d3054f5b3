"""Neighbours, resampling, selection and splits."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from solea.operators import boosting as B
from solea.operators import features as X
from solea.operators import forests as T
from solea.operators import learners as L
from solea.operators import neighbours as N
from solea.operators import splits as S
from solea.operators.perceptron import fit_perceptron, loss_and_slope, minimised
from solea.plans import learning as P

RNG = np.random.default_rng(11)


def wide(spark, x, y=None, start=0):
    y = np.zeros(len(x), dtype=int) if y is None else y
    rows = [(start + i, int(y[i]), i % 3, [float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, "id bigint, y int, fold int, x array<double>")


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(N, "_BLOCK", block)
    refs = np.concatenate([RNG.normal(0, 1, (80, 3)), RNG.normal(8, 1, (60, 3)), np.zeros((5, 3))])
    asks = np.concatenate([RNG.normal(0, 2, (20, 3)), np.zeros((1, 3)), RNG.normal(4, 1, (9, 3))])
    got = N.nearest(wide(spark, asks, start=1000), wide(spark, refs), 4, pivots=6).collect()
    for i, a in enumerate(asks):
        d = np.sqrt(((refs - a) ** 2).sum(axis=1))
        want = sorted(range(len(refs)), key=lambda j: (d[j], j))[:4]
        assert [r.ref for r in sorted((r for r in got if r.id == 1000 + i), key=lambda r: r.rank)] == want


def test_smote_balances_between_parents(spark):
    x, y = RNG.normal(size=(40, 4)), np.array([1] * 9 + [0] * 31)
    rows = N.smote(wide(spark, x, y)).collect()
    assert sum(r.y == 1 for r in rows) == sum(r.y == 0 for r in rows) == 31
    for r in rows:
        if r.parent is not None:
            a, b, p = x[r.parent], x[r.partner], np.array(r.x)
            assert r.parent != r.partner and y[r.parent] == y[r.partner] == 1
            t = (p - a) @ (b - a) / ((b - a) @ (b - a))
            assert -1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * (b - a), p)


def test_correlation_filter_is_greedy(spark):
    base = RNG.normal(size=(60, 3))
    x = np.column_stack([base[:, 0], base[:, 1], base[:, 0] * 2 + 1e-4 * base[:, 2], base[:, 2], -base[:, 1]])
    assert X.correlation_filter(X.correlation_matrix(wide(spark, x))) == [0, 1, 3]


def test_discriminant_matches_closed_form(spark):
    y = np.array([0] * 50 + [1] * 40)
    x = RNG.normal(size=(90, 3)) + y[:, None] * np.array([1.0, -0.5, 0.2])
    train = wide(spark, x, y)
    got = {r.id: r.prob for r in L.discriminant(train, train).collect()}
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    c = x - np.where(y[:, None] == 1, m1, m0)
    w = np.linalg.solve(c.T @ c / 90, m1 - m0)
    want = 1 / (1 + np.exp(-(x @ w - 0.5 * w @ (m0 + m1) + np.log(40 / 50))))
    assert np.allclose([got[i] for i in range(90)], want, atol=1e-8)


@pytest.mark.parametrize("name", ["AdaBoost", "KNN", "LogisticRegression", "SVM"])
def test_classifiers_separate_clear_classes(spark, name):
    y = np.array([0, 1] * 40)
    x = RNG.normal(scale=0.4, size=(80, 2)) + y[:, None] * 2.0
    train = wide(spark, x, y)
    fit = (lambda a, b: L.ada_stumps(a, b, 12)) if name == "AdaBoost" else L.CLASSIFIERS[name]
    right = [(r.prob >= 0.5) == (r.y == 1) for r in fit(train, train).collect()]
    assert np.mean(right) >= 0.95


def test_search_shares_folds_and_goes_on_after_a_break(spark, monkeypatch):
    y = np.array([0, 0, 1] * 20)
    x = RNG.normal(size=(60, 3)) + y[:, None] * np.array([1.5, 0.5, 0.0])
    data, rankings = wide(spark, x, y).withColumn("fold", F.pmod(F.floor(F.col("id") / 3), F.lit(2)).cast("int")), {"A": [0, 1, 2], "B": [0, 2, 1]}
    asked = []
    filled = L.filled_folds
    monkeypatch.setattr(L, "filled_folds", lambda rows, features: asked.append(tuple(features)) or filled(rows, features))
    whole = L.search_folds(data, rankings, ["LDA"], [1, 2])
    assert asked == [(0,), (0, 1), (0, 2)]  # one set of folds where rankings agree
    rows = [tuple(r) for r in whole.orderBy("loop", "fold").collect()]
    assert [r[:4] for r in rows[::2]] == [(0, "A", "LDA", 1), (1, "A", "LDA", 2), (2, "B", "LDA", 1), (3, "B", "LDA", 2)] and [r[4] for r in rows] == [0, 1] * 4
    asked.clear()
    assert [tuple(r) for r in L.search_folds(data, rankings, ["LDA"], [1, 2], done=whole.where("loop < 3")).orderBy("loop", "fold").collect()] == rows and asked == [(0, 2)]
    preds = L.cross_validate(data, [0, 2], "LDA").collect()
    for fold, auc in ((r[4], r[5]) for r in rows[6:]):
        p, n = ([q.prob for q in preds if q.fold == fold and q.y == k] for k in (1, 0))
        assert auc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in p for b in n]))


def test_registered_search_covers_the_whole_grid(spark, monkeypatch):
    """Every ranking with every classifier and every number of features, in the loop order of the work this follows."""
    y = np.array([0, 0, 1] * 20)
    x = np.random.default_rng(3).normal(size=(60, 3)) + y[:, None] * np.array([1.5, 0.5, 0.0])
    rows = [(i, int(y[i]), i // 3 % 3, f, float(x[i, f])) for i in range(60) for f in range(3)]
    t = type("Rows", (), {"features": spark.createDataFrame(rows, "id bigint, y int, fold int, feature int, x double")})
    order = {"RF": [0, 1, 2], "XGBoost": [0, 1, 2], "ExtraTree": [0, 2, 1]}
    monkeypatch.setattr(L, "feature_ranking", lambda train, method: spark.createDataFrame([(f, r) for r, f in enumerate(order[method], 1)], "feature int, rank int"))
    assert len(L.CLASSIFIERS) == 10
    asked = []
    monkeypatch.setattr(L, "search_grid", lambda train, *grid: asked.append(grid))
    P.searched(t)
    assert asked == [(order, list(L.CLASSIFIERS), [1, 2, 3])]
    monkeypatch.undo()
    monkeypatch.setattr(L, "feature_ranking", lambda train, method: spark.createDataFrame([(f, r) for r, f in enumerate(order[method], 1)], "feature int, rank int"))
    monkeypatch.setattr(L, "CLASSIFIERS", {"LDA": L.discriminant, "LogisticRegression": L.logistic})
    found = [tuple(r)[:4] for r in P.searched(t)[3].orderBy("loop").collect()]
    grid = [(m, c, n) for m in order for c in ("LDA", "LogisticRegression") for n in (1, 2, 3)]
    assert found == [(i, *key) for i, key in enumerate(grid)]


def test_patients_stay_together_and_classes_spread(spark):
    rows = [(i, i // 2, int(i // 2 % 3 == 0)) for i in range(400)]
    images = spark.createDataFrame(rows, "image_id bigint, subject bigint, y int")
    folds = S.grouped_stratified_folds(images).cache()
    assert folds.count() == 400 and S.split_leaks(folds).count() == 0
    per = folds.groupBy("fold").agg(F.count_distinct("subject").alias("n"), F.sum(F.when(F.col("image_id") % 2 == 0, F.col("y"))).alias("pos")).collect()
    test, cv = [r for r in per if r.fold == -1], [r for r in per if r.fold >= 0]
    assert test[0].n == 41 or abs(test[0].n - 40) <= 1
    assert max(r.n for r in cv) - min(r.n for r in cv) <= 2 and max(r.pos for r in cv) - min(r.pos for r in cv) <= 1


@pytest.mark.parametrize("small", [60, 10_000])
def test_forests_grow_whole_trees_and_leave_only_their_tops_on_the_driver(spark, monkeypatch, small):
    monkeypatch.setattr(T, "SMALL", small)
    y = RNG.integers(0, 2, 500)
    x = RNG.normal(size=(500, 6))
    x[:, 2] += y
    train = wide(spark, x, y, start=-200).repartition(3)
    whole = T.Forest(train, 5, bootstrap=False, balanced=True, seed=1)
    nodes = [len(tree[0]) for tree in whole.top]
    assert max(nodes) == 1 if small > 500 else 500 / small < min(nodes) and max(nodes) < 500 / 5  # a whole tree has far more
    got = {r.id: r.prob for r in whole.probabilities(train).collect()}
    assert [got[i - 200] for i in range(500)] == [float(v) for v in y]  # grown until every leaf is pure
    share = T.Forest(train, 20, bootstrap=True, balanced=False, seed=1).importances()
    assert share.sum() == pytest.approx(1) and share.argmax() == 2
    again = [{r.id: r.prob for r in T.Forest(df, 4, bootstrap=True, balanced=True, seed=3).probabilities(df.limit(1000)).collect()} for df in (train, train.repartition(7))]
    assert again[0] == again[1] and len(set(again[0].values())) > 2


def test_forest_splits_at_the_best_gini_bin():
    bins = RNG.integers(0, 32, (300, 4)).astype(np.uint8)
    y, w = RNG.integers(0, 2, 300), RNG.integers(1, 4, 300).astype(float)
    at, last, gain = T._best(T._histograms(np.zeros(300, dtype=int), 1, bins, y, w, np.array([[3, 1, 0, 2]])))
    gini = lambda m: 2 * (w[m] @ y[m]) * (w[m] @ (1 - y[m])) / w[m].sum() if m.any() else 0.0
    best = min((gini(bins[:, f] <= c) + gini(bins[:, f] > c), k) for k, (f, c) in enumerate((f, c) for f in (3, 1, 0, 2) for c in range(31)))
    assert (at[0], last[0]) == divmod(best[1], 31) and 2 * gain[0] == pytest.approx(gini(y >= 0) - best[0])


def test_forest_of_hot_rows_and_of_one_class(spark, monkeypatch):
    monkeypatch.setattr(T, "SMALL", 20)
    rows = wide(spark, np.ones((90, 2)), [1] * 30 + [0] * 60)  # equal rows cannot be split, however many
    assert [r.prob for r in T.Forest(rows, 3, False, False, 1).probabilities(rows).collect()] == pytest.approx([1 / 3] * 90)
    rows = wide(spark, RNG.normal(size=(50, 2)), [1] * 50)
    assert [r.prob for r in L.forest(rows, rows, 3).collect()] == [1.0] * 50


def test_boosted_ranking_is_sparks_without_a_job_a_round(spark):
    from pyspark.ml.classification import GBTClassifier

    x = RNG.integers(0, 9, (400, 5)).astype(float)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] / 4 + RNG.normal(scale=2, size=400)) > 9).astype(int)
    train = wide(spark, x, y)
    for rounds, depth, near in ((1, 6, 1e-9), (10, 2, 1e-6), (30, 6, 0.02)):  # in small nodes equal splits are told apart by rounding only
        want = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=L.SEED).fit(L._vectors(train)).featureImportances.toArray()
        assert np.allclose(B.importances(train, rounds, depth, 0.3, L.SEED), want, atol=near)
    context = spark.sparkContext
    context.setJobGroup("boosted ranking", "")
    L.feature_ranking(train, "XGBoost", trees=30).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("boosted ranking"))
    context.setJobGroup("after", "")
    assert jobs < 30


def test_perceptron_over_partitions(spark):
    """The same start as Spark's own and as low a loss; the gradient comes from blocks of all partitions, odd sizes and an empty one among them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2100, 6))
    y = ((x[:, 0] * x[:, 1] + x[:, 2]) > 0).astype(int)
    rows = [(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    train = df.where("id < 1500").repartition(3).union(df.where("id >= 1500").coalesce(1)).union(df.where("false"))

    def loss(weights):
        return loss_and_slope(weights, x, y, 10)[0] / len(y)

    own = {n: MultilayerPerceptronClassifier(layers=[6, 10, 2], maxIter=n, seed=L.SEED).fit(L._vectors(df.coalesce(1))).weights.toArray() for n in (0, 60)}
    whole = minimised(lambda w: tuple(v / len(y) for v in loss_and_slope(w, x, y, 10)), own[0], 4)
    for n, weights in ((0, own[0]), (4, whole)):
        assert np.allclose(fit_perceptron(train, 10, n, L.SEED).weights.toArray(), weights, atol=1e-6)
    assert loss(fit_perceptron(train, 10, 60, L.SEED).weights.toArray()) < max(2 * loss(own[60]), 0.01)
    slope, at = loss_and_slope(whole, x, y, 10)[1], np.eye(len(whole)) * 1e-6
    for k in (0, 41, 62, 72, 75, 91):
        assert np.isclose((loss(whole + at[k]) - loss(whole - at[k])) / 2e-6 * len(y), slope[k], rtol=1e-3, atol=1e-3)
