"""Published numbers and brute-force twins of the statistical operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from solea.functions.scalars import chi2_1_tail, normal_two_sided, score_slot
from solea.operators import metrics as M
from solea.operators import paired_tests as P
from solea.operators import training_curves as L

RNG = np.random.default_rng(7)


def paired_rows(b, c, same=5):
    return [(i, "m", 1, 0.9, 0.1) for i in range(b)] + [(100 + i, "m", 1, 0.1, 0.9) for i in range(c)] + [(200 + i, "m", 1, 0.9, 0.9) for i in range(same)]


@pytest.mark.parametrize("b,c,p", [(7, 4, 0.5488), (0, 6, 0.0312), (0, 0, 1.0), (12, 12, 1.0), (5, 20, 0.00511)])
def test_mcnemar(spark, b, c, p):
    df = spark.createDataFrame(paired_rows(b, c), "sample_id int, run string, y int, p_a double, p_b double")
    row = P.mcnemar(df, ["run"]).first()
    assert (row.b, row.c) == (b, c) and row.p_value == pytest.approx(p, abs=1e-4)


def test_tails_match_erfc(spark):
    zs = [0.0, 0.1, 0.5, 1.0, 1.96, 3.0, 5.0, 9.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for z, (two, chi) in zip(zs, df.select(normal_two_sided(F.col("z")), chi2_1_tail(F.col("z") * F.col("z"))).collect()):
        assert two == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-12) and chi == pytest.approx(two, abs=1e-12)


def brute_auc(y, p):
    d = p[y == 1][:, None] - p[y == 0][None, :]
    return ((d > 0) + 0.5 * (d == 0)).mean()


def scored(n=400):
    y = RNG.integers(0, 2, n)
    a, b = np.round(RNG.normal(y, 1.5), 1), RNG.normal(y, 2.0)
    return pd.DataFrame({"sample_id": range(n), "run": "r", "y": y, "p_a": a, "p_b": b})


def test_auc_and_delong_against_pairs(spark):
    pdf = scored()
    row = P.delong(spark.createDataFrame(pdf), ["run"]).first()
    y = pdf.y.to_numpy()
    v10, v01 = [], []
    for c in ("p_a", "p_b"):
        p = pdf[c].to_numpy()
        d = p[y == 1][:, None] - p[y == 0][None, :]
        k = (d > 0) + 0.5 * (d == 0)
        v10.append(k.mean(axis=1)), v01.append(k.mean(axis=0))
    s = np.cov(*v10) / (y == 1).sum() + np.cov(*v01) / (y == 0).sum()
    delta = v10[0].mean() - v10[1].mean()
    z = delta / math.sqrt(s[0, 0] + s[1, 1] - 2 * s[0, 1])
    assert row.delta == pytest.approx(delta, abs=1e-12) and row.z == pytest.approx(z, abs=1e-9)
    assert row.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-9)
    auc = M.auc(spark.createDataFrame(pdf), ["run"], "p_a").first().auc
    assert auc == pytest.approx(brute_auc(y, pdf.p_a.to_numpy()), abs=1e-12)


def test_delong_of_a_model_with_itself(spark):
    pdf = scored(50).assign(p_b=lambda d: d.p_a)
    row = P.delong(spark.createDataFrame(pdf), ["run"]).first()
    assert (row.delta, row.z, row.p_value) == (0.0, 0.0, 1.0)


def test_one_class_group_has_no_auc(spark):
    df = spark.createDataFrame([("r", 1, 0.2), ("r", 1, 0.4)], "run string, y int, p double")
    assert M.auc(df, ["run"]).first().auc is None


def test_bootstrap_against_row_resampling(spark):
    """Histogram draws and row draws follow the same distribution; limits agree within sampling error.

    Half of the scores lie so close together that they share a slot, which exercises the second drawing stage.
    """
    n = 120
    y = RNG.integers(0, 2, n)
    p = np.where(RNG.random(n) < 0.5, 0.5 + RNG.normal(y, 1.0) * 1e-6, 1 / (1 + np.exp(-RNG.normal(y, 1.0))))
    pdf = pd.DataFrame({"run": "r", "y": y, "p": p})
    got = {r.metric: r for r in P.bootstrap_ci(spark.createDataFrame(pdf), ["run"], "p", 0.5, 2000).collect()}
    pos, neg, values = np.flatnonzero(y == 1), np.flatnonzero(y == 0), []
    for _ in range(2000):
        i, j = RNG.choice(pos, len(pos)), RNG.choice(neg, len(neg))
        yy, pp = y[np.r_[i, j]], p[np.r_[i, j]]
        values.append((brute_auc(yy, pp), (pp[yy == 1] >= 0.5).mean(), (pp[yy == 0] < 0.5).mean()))
    want = np.percentile(values, [2.5, 97.5], axis=0)
    for k, m in enumerate(("auc", "sens", "spec")):
        assert got[m].n_valid == 2000
        assert got[m].lo == pytest.approx(want[0][k], abs=0.025) and got[m].hi == pytest.approx(want[1][k], abs=0.025)


def test_youden_takes_the_first_best_threshold(spark):
    df = spark.createDataFrame([("r", 1, 0.9), ("r", 0, 0.8), ("r", 1, 0.7), ("r", 0, 0.1)], "run string, y int, p double")
    row = M.youden_threshold(df, ["run"]).first()
    assert (row.threshold, row.sens, row.spec) == (0.9, 0.5, 1.0)


def test_threshold_sweep_falls_back_to_best_sum(spark):
    rows = [("r", 1, 0.9), ("r", 1, 0.2), ("r", 0, 0.8), ("r", 0, 0.1)]
    row = M.threshold_sweep(spark.createDataFrame(rows, "run string, y int, p double"), ["run"]).first()
    assert not row.meets_floor and row.threshold == pytest.approx(0.15)


def test_early_stop_replay(spark):
    series = {"a": [5, 4, 4, 4, 3, 3, 3, 3], "b": [3, 2, 1], "c": [1, 2, 2, 2, 0]}
    rows = [(k, i, float(v), i // 2) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run string, i int, loss double, slot int")
    got = {r.run: (r.stop_epoch, r.best_epoch, r.best_loss, r.epochs_used) for r in L.early_stop(df, "run", ["i"], "loss", "slot", 3).collect()}
    assert got == {"a": (8, 5, 3.0, 8), "b": (None, 3, 1.0, 3), "c": (4, 1, 1.0, 4)}


@pytest.mark.parametrize("low,high,most", [(0.0, 1.0, 0.01), (0.99, 1.0, 0.01), (0.0, 0.01, 0.01), (1 - 1e-6, 1.0, 0.02), (-1e-6, 1e-6, 0.02), (-8.0, 8.0, 0.01)])
def test_crowded_scores_are_spread_over_slots(spark, low, high, most):
    p = np.sort(RNG.uniform(low, high, 20000))
    slots = np.array([r[0] for r in spark.createDataFrame(pd.DataFrame({"p": p})).select("p", score_slot(F.col("p")).alias("slot")).orderBy("p").select("slot").collect()])
    assert (np.diff(slots) >= 0).all() and np.unique(slots, return_counts=True)[1].max() <= most * len(p)


def test_slots_of_odd_scores(spark):
    odd = [None, float("nan"), float("-inf"), -1e300, -1.0, -0.0, 0.0, 1e-300, 0.5, 1.0, 2.0, 1e300, float("inf")]
    slots = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, p double").orderBy("i").select(score_slot(F.col("p"))).collect()]
    assert slots[0] == slots[1] == 3 * 4096 + 1 and None not in slots and slots[5] == slots[6]
    assert slots[2:] == sorted(slots[2:])
    p = np.concatenate([RNG.uniform(0.99, 1, 300), RNG.choice([0.0, 0.995, 1.0], 100)])
    y = RNG.integers(0, 2, 400)
    df = spark.createDataFrame(pd.DataFrame({"run": "m", "y": y, "p": p}))
    assert M.auc(df, ["run"]).first().auc == pytest.approx(brute_auc(y, p), abs=1e-12)
    assert M.roc_curve(df, ["run"]).where("tpr = 1 AND fpr = 1").count() >= 1
