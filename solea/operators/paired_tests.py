"""Paired comparison of two models on the same samples."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solea.functions.running import running
from solea.functions.scalars import binomial_half_cdf, chi2_1_tail, normal_two_sided, score_slot
from solea.operators.metrics import score_histogram
from solea.session import cut_lineage

SIX = ("sens", "spec", "ppv", "npv", "f1", "auc")


def pair_predictions(a: DataFrame, b: DataFrame, key: str = "sample_id") -> DataFrame:
    """Align model a ``(key, by..., y, p)`` with model b ``(key, p)`` by sample."""
    return a.withColumnRenamed("p", "p_a").join(b.select(key, F.col("p").alias("p_b")), key)


def _right(score: str, threshold: float):
    return (F.col(score) >= threshold).cast("int") == F.col("y")


def discordant_cases(paired: DataFrame, thr_a: float = 0.5, thr_b: float = 0.5) -> DataFrame:
    """Positives where exactly one model is right: tag b when only the first is, c when only the second is."""
    a, b = _right("p_a", thr_a), _right("p_b", thr_b)
    tagged = paired.filter((F.col("y") == 1) & (a != b)).withColumn("tag", F.when(a, F.lit("b")).otherwise(F.lit("c")))
    return tagged.withColumns({"p_a4": F.bround("p_a", 4), "p_b4": F.bround("p_b", 4)})


def mcnemar(paired: DataFrame, by: list[str], thr_a: float = 0.5, thr_b: float = 0.5, positives_only: bool = False) -> DataFrame:
    """Exact two-sided binomial below 25 discordant pairs, continuity-corrected chi-square from 25 on."""
    rows = paired.filter(F.col("y") == 1) if positives_only else paired
    a, b = _right("p_a", thr_a), _right("p_b", thr_b)
    counts = rows.groupBy(*by).agg(
        F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"), F.count(F.lit(1)).alias("n_samples")
    )
    n = F.col("b") + F.col("c")
    exact = F.least(F.lit(1.0), 2.0 * binomial_half_cdf(F.least("b", "c"), n))
    gap = F.abs(F.col("b") - F.col("c")) - 1
    stat = F.try_divide((gap * gap).cast("double"), n.cast("double"))
    return counts.withColumn("p_value", F.when(n == 0, 1.0).when(n < 25, exact).otherwise(chi2_1_tail(stat)))


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def _placements(hist: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """Per distinct score: the share of the other class that a positive (negative) with this score beats (loses to)."""
    slotted = hist.withColumn("slot", score_slot(F.col(score)))
    cum = running(slotted, by, "slot", [F.col(score)], cp=("sum", F.col("pos")), cn=("sum", F.col("neg")))
    totals = hist.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return cum.join(totals, by).select(
        *by, score,
        F.try_divide(F.col("cn") - F.col("neg") / 2.0, F.col("N")).alias(f"v10_{name}"),
        F.try_divide(F.col("P") - F.col("cp") + F.col("pos") / 2.0, F.col("P")).alias(f"v01_{name}"),
    )


def delong(paired: DataFrame, by: list[str]) -> DataFrame:
    """DeLong's test for two correlated AUCs: delta, z and two-sided p.

    Placement values come from running counts per distinct score. Samples are grouped to distinct
    (label, score a, score b) before the placement tables are joined on.
    """
    cells = paired.groupBy(*by, "y", "p_a", "p_b").agg(F.count(F.lit(1)).alias("w"))
    pos, neg = F.col("y") * F.col("w"), (1 - F.col("y")) * F.col("w")

    def hist(score: str) -> DataFrame:
        return cells.groupBy(*by, score).agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg"))

    joined = cells.join(_placements(hist("p_a"), by, "p_a", "a"), [*by, "p_a"]).join(
        _placements(hist("p_b"), by, "p_b", "b"), [*by, "p_b"]
    )
    va = F.when(F.col("y") == 1, F.col("v10_a")).otherwise(F.col("v01_a"))
    vb = F.when(F.col("y") == 1, F.col("v10_b")).otherwise(F.col("v01_b"))
    values = joined.select(*by, "y", F.col("w").cast("double").alias("w"), va.alias("a"), vb.alias("b"))
    d = F.col("a") - F.col("b")
    per_class = values.groupBy(*by, "y").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("a")).alias("sa"), F.sum(F.col("w") * F.col("b")).alias("sb"),
        F.sum(F.col("w") * d).alias("sd"), F.sum(F.col("w") * d * d).alias("sdd"),
    )
    # var(a) + var(b) - 2 cov(a, b) of a class is the sample variance of a - b
    spread = F.try_divide(F.col("sdd") - F.col("sd") * F.col("sd") / F.col("n"), F.col("n") - 1)
    rows = per_class.withColumn("part", F.try_divide(spread, F.col("n")))
    out = rows.groupBy(*by).agg(
        F.max(F.when(F.col("y") == 1, F.col("sa") / F.col("n"))).alias("auc_a"),
        F.max(F.when(F.col("y") == 1, F.col("sb") / F.col("n"))).alias("auc_b"),
        F.sum("part").alias("var_delta"),
    ).withColumn("delta", F.col("auc_a") - F.col("auc_b"))
    flat = F.coalesce(F.col("var_delta") <= 1e-18, F.lit(True))
    z = F.when(flat, 0.0).otherwise(F.try_divide(F.col("delta"), F.sqrt("var_delta")))
    return out.withColumn("z", z).withColumn("p_value", F.when(flat, 1.0).otherwise(normal_two_sided(F.col("z"))))


def _key_seed(key: tuple) -> list[int]:
    return [zlib.crc32(str(k).encode()) for k in key]


def _draw(rng: np.random.Generator, counts: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """One multinomial row per repetition: ``reps[i]`` draws over cells in proportion to ``counts``."""
    total = counts.sum()
    if total == 0:
        return np.zeros((len(reps), len(counts)), dtype=np.int64)
    return rng.multinomial(reps, counts / total)


def bootstrap_ci(preds: DataFrame, by: list[str], score: str = "p", threshold: float = 0.5, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Class-stratified bootstrap percentiles (2.5, 97.5) of six metrics.

    Drawing n samples with replacement and counting them per distinct score is a multinomial draw over the score
    histogram, so the histogram is resampled instead of the rows: first over score slots (one task per group and
    block of repetitions, at most 1538 slots), then inside every slot that holds several scores. Work does not grow
    with the sample count, and no group is larger than its slots.
    """
    block = 500
    keys = dict(preds.dtypes)
    key_schema = "".join(f"{c} {keys[c]}, " for c in by)
    hist = cut_lineage(score_histogram(preds, by, score).withColumn("slot", score_slot(F.col(score), 256)))  # read several times
    slots = hist.groupBy(*by, "slot").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("scores"),
        F.max((F.col(score) >= threshold).cast("int")).alias("hit"),
    )
    blocks = slots.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // block))))

    def over_slots(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        rng = np.random.default_rng([seed, 1, *_key_seed(key)])
        size = min(block, n_boot - int(key[-1]) * block)
        pos = _draw(rng, pdf.pos.to_numpy(), np.full(size, pdf.pos.sum()))
        neg = _draw(rng, pdf.neg.to_numpy(), np.full(size, pdf.neg.sum()))
        single = (pdf.scores == 1).to_numpy()
        hit = single & (pdf.hit == 1).to_numpy()
        wins = (pos * (np.cumsum(neg, axis=1) - neg)).sum(axis=1) + (pos * neg / 2.0)[:, single].sum(axis=1)
        rows = [(None, pos.sum(axis=1), neg.sum(axis=1), pos[:, hit].sum(axis=1), neg[:, hit].sum(axis=1), wins)]
        none = np.zeros(0)
        rows += [(int(pdf.slot.iloc[i]), pos[:, i], neg[:, i], none, none, none) for i in np.flatnonzero(~single)]
        out = pd.DataFrame(rows, columns=["slot", "pos", "neg", "tp", "fp", "wins"])
        out["slot"] = out["slot"].astype("Int64")
        for i, c in enumerate([*by, "block"]):
            out[c] = key[i]
        return out[[*by, "block", "slot", "pos", "neg", "tp", "fp", "wins"]]

    arrays = "pos array<bigint>, neg array<bigint>, tp array<bigint>, fp array<bigint>, wins array<double>"
    drawn = blocks.groupBy(*by, "block").applyInPandas(over_slots, f"{key_schema}block int, slot int, {arrays}")

    def inside_slot(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cells = right.sort_values(score)
        hit = (cells[score].to_numpy() >= threshold).astype(np.int64)
        rows = []
        for row in left.itertuples(index=False):
            rng = np.random.default_rng([seed, 2, int(row.block), *_key_seed(key)])
            pos = _draw(rng, cells.pos.to_numpy(), np.asarray(row.pos))
            neg = _draw(rng, cells.neg.to_numpy(), np.asarray(row.neg))
            zero = np.zeros(len(pos), dtype=np.int64)
            rows.append((row.block, zero, zero, pos @ hit, neg @ hit, (pos * (np.cumsum(neg, axis=1) - neg / 2.0)).sum(axis=1)))
        out = pd.DataFrame(rows, columns=["block", "pos", "neg", "tp", "fp", "wins"])
        for i, c in enumerate(by):
            out[c] = key[i]
        return out[[*by, "block", "pos", "neg", "tp", "fp", "wins"]]

    cols = [*by, "block", "pos", "neg", "tp", "fp", "wins"]
    shared = slots.filter("scores > 1").select(*by, "slot")
    if shared.isEmpty():
        parts = drawn.select(cols)
    else:
        drawn = cut_lineage(drawn)
        many = hist.join(shared, [*by, "slot"], "left_semi")
        refined = (
            drawn.filter(F.col("slot").isNotNull()).groupBy(*by, "slot").cogroup(many.groupBy(*by, "slot"))
            .applyInPandas(inside_slot, f"{key_schema}block int, {arrays}")
        )
        parts = drawn.filter(F.col("slot").isNull()).select(cols).unionByName(refined.select(cols))
    reps = (
        parts.select(*by, "block", F.posexplode(F.arrays_zip("pos", "neg", "tp", "fp", "wins")).alias("at", "v"))
        .groupBy(*by, "block", "at")
        .agg(*[F.sum(F.col(f"v.{c}")).cast("double").alias(c) for c in ("pos", "neg", "tp", "fp", "wins")])
    )
    metrics = reps.select(
        *by,
        F.expr("stack(6, 'sens', try_divide(tp, pos), 'spec', try_divide(neg - fp, neg), 'ppv', try_divide(tp, tp + fp), "
               "'npv', try_divide(neg - fp, neg - fp + pos - tp), 'f1', coalesce(try_divide(2*tp, tp + fp + pos), 0.0D), "
               "'auc', try_divide(wins, pos * neg)) as (metric, value)"),
    )
    # one value per repetition, so at most n_boot values per group
    return metrics.groupBy(*by, "metric").agg(
        F.bround(F.percentile("value", 0.025), 4).alias("lo"), F.bround(F.percentile("value", 0.975), 4).alias("hi"),
        F.count("value").alias("n_valid"),
    )


def comparison_report(metrics_a: DataFrame, metrics_b: DataFrame, by: list[str], ci_a: DataFrame | None = None, ci_b: DataFrame | None = None) -> DataFrame:
    """Two models by six metrics with their difference, and the bootstrap limits where given."""
    stack = F.expr("stack(6, " + ", ".join(f"'{m}', {m}" for m in SIX) + ") as (metric, value)")
    a = metrics_a.select(*by, stack).withColumnRenamed("value", "value_a")
    b = metrics_b.select(*by, stack).withColumnRenamed("value", "value_b")
    out = a.join(b, [*by, "metric"]).withColumn("delta", F.col("value_a") - F.col("value_b"))
    for ci, tag in ((ci_a, "a"), (ci_b, "b")):
        if ci is not None:
            out = out.join(ci.select(*by, "metric", F.col("lo").alias(f"lo_{tag}"), F.col("hi").alias(f"hi_{tag}")), [*by, "metric"], "left")
    return out
