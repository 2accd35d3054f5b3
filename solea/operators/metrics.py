"""Metrics over prediction tables: one row per scored sample with a 0/1 label ``y`` and a score column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solea.functions.running import running
from solea.functions.scalars import ratio, score_slot

# Metric names in report order and the floors of the model gate.
METRICS = ("auc", "sens", "spec", "ppv", "npv", "f1", "acc")
CRITERIA = {"auc": 0.80, "sens": 0.85, "spec": 0.70}


def preds_from_folds(fold_arrays: DataFrame, labels: DataFrame) -> DataFrame:
    """Keyed fold arrays ``(run_no, fold, p[])`` to one row per sample, aligned by position with ``(fold, pos, ...)``."""
    long = fold_arrays.select("run_no", "fold", F.posexplode("p").alias("pos", "p"))
    return long.join(labels, ["run_no", "fold", "pos"])


def binarise(preds: DataFrame, score: str = "p", threshold: float | Column = 0.5) -> DataFrame:
    return preds.withColumn("pred", (F.col(score) >= threshold).cast("int"))


def confusion_counts(preds: DataFrame, by: list[str], score: str = "p", threshold: float | Column = 0.5) -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col("y") == 1
    return preds.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(hit & ~pos).alias("fp"),
    )


def binary_metrics(counts: DataFrame) -> DataFrame:
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    return counts.withColumns(
        {
            "sens": ratio(tp, tp + fn),
            "spec": ratio(tn, tn + fp),
            "ppv": ratio(tp, tp + fp),
            "npv": ratio(tn, tn + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "acc": ratio(tp + tn, tp + tn + fp + fn),
        }
    )


def score_histogram(preds: DataFrame, by: list[str], score: str = "p") -> DataFrame:
    """Class counts per distinct score. Everything rank-based works on this, never on the raw rows."""
    return preds.groupBy(*by, score).agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"), F.sum((1 - F.col("y")).cast("bigint")).alias("neg")
    )


def auc(preds: DataFrame, by: list[str], score: str = "p") -> DataFrame:
    """Tie-aware area under the ROC curve; null where a group has one class only.

    Pairs are counted inside (group, score slot), then across slots, so a hot group is spread over its slots.
    """
    return _rank_sums(score_histogram(preds, by, score), by, score, 0.5).select(*by, "auc", "n_pos", "n_neg")


def _rank_sums(hist: DataFrame, by: list[str], score: str, threshold: float) -> DataFrame:
    """AUC, class totals and confusion counts of a score histogram in one flow, without a join."""
    hist = hist.withColumn("slot", score_slot(F.col(score)))
    inside = Window.partitionBy(*by, "slot").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0)).cast("double")
    hit = F.col(score) >= threshold
    slots = (
        hist.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2.0))
        .groupBy(*by, "slot")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("wins").alias("wins"),
             F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"))
    )
    before = Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("neg").over(before), F.lit(0)).cast("double")
    sums = slots.withColumn("wins", F.col("wins") + F.col("pos") * earlier).groupBy(*by).agg(
        F.try_divide(F.sum("wins"), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
    )
    return sums.withColumns({"fn": F.col("n_pos") - F.col("tp"), "tn": F.col("n_neg") - F.col("fp")})


def fold_metrics(preds: DataFrame, by: list[str], score: str = "p", threshold: float = 0.5) -> DataFrame:
    """Counts, ratio metrics and AUC per group from one pass over the raw rows."""
    return binary_metrics(_rank_sums(score_histogram(preds, by, score), by, score, threshold).drop("n_pos", "n_neg"))


def fold_summary(per_fold: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and population spread of each metric over folds, one row per (group, metric)."""
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    long = per_fold.select(*by, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def run_summary(per_fold: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """The same numbers in wide form: ``auc_mean, auc_std, ...``."""
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return per_fold.groupBy(*by).agg(*aggs)


def class_report(preds: DataFrame, by: list[str], score: str = "p", threshold: float = 0.5) -> DataFrame:
    """Per class precision, recall, F1 and support, with accuracy, macro and weighted means as further rows."""
    c = confusion_counts(preds, by, score, threshold)
    tp, fn, tn, fp = (F.col(x) for x in ("tp", "fn", "tn", "fp"))
    side = F.explode(
        F.array(
            F.struct(F.lit("0").alias("label"), tn.alias("hit"), (tn + fn).alias("said"), (tn + fp).alias("support")),
            F.struct(F.lit("1").alias("label"), tp.alias("hit"), (tp + fp).alias("said"), (tp + fn).alias("support")),
        )
    )
    per = c.select(*by, side.alias("s")).select(*by, "s.*")
    per = per.withColumns(
        {
            "precision": ratio(F.col("hit"), F.col("said")),
            "recall": ratio(F.col("hit"), F.col("support")),
            "f1": ratio(2 * F.col("hit"), F.col("said") + F.col("support")),
        }
    )
    values = ("precision", "recall", "f1")
    total = F.sum("support").alias("support")
    macro = per.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values], total).withColumn("label", F.lit("macro avg"))
    weighted = per.groupBy(*by).agg(
        *[ratio(F.sum(F.col(v) * F.col("support")), F.sum("support")).alias(v) for v in values], total
    ).withColumn("label", F.lit("weighted avg"))
    accuracy = per.groupBy(*by).agg(ratio(F.sum("hit"), F.sum("support")).alias("f1"), total).select(
        *by, F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), "f1", "support",
    )
    cols = [*by, "label", *values, "support"]
    return per.select(cols).unionByName(macro.select(cols)).unionByName(weighted.select(cols)).unionByName(accuracy.select(cols))


def class_weights(preds: DataFrame, by: list[str]) -> DataFrame:
    """n / (k * n_c) per class present in the group."""
    counts = preds.groupBy(*by, "y").count()
    group = Window.partitionBy(*by)
    return counts.withColumn(
        "weight", F.sum("count").over(group) / (F.count(F.lit(1)).over(group) * F.col("count"))
    )


def roc_curve(preds: DataFrame, by: list[str], score: str = "p") -> DataFrame:
    """Cumulative rates per distinct score from the highest down, starting at (0, 0) with an infinite threshold."""
    hist = score_histogram(preds, by, score).withColumn("slot", -score_slot(F.col(score)))
    cum = running(hist, by, "slot", [F.col(score).desc()], tp=("sum", F.col("pos")), fp=("sum", F.col("neg")))
    totals = hist.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    points = cum.join(totals, by).select(
        *by,
        F.col(score).cast("double").alias("threshold"),
        F.try_divide(F.col("tp").cast("double"), F.col("n_pos")).alias("tpr"),
        F.try_divide(F.col("fp").cast("double"), F.col("n_neg")).alias("fpr"),
    )
    start = totals.select(
        *by, F.lit(float("inf")).alias("threshold"),
        F.try_divide(F.lit(0.0), F.col("n_pos")).alias("tpr"), F.try_divide(F.lit(0.0), F.col("n_neg")).alias("fpr"),
    )
    return points.unionByName(start)


def youden_threshold(preds: DataFrame, by: list[str], score: str = "p") -> DataFrame:
    """The highest threshold among those that maximise sensitivity + specificity - 1."""
    curve = roc_curve(preds, by, score).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = curve.filter(F.col("j").isNotNull()).groupBy(*by).agg(
        F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct("j", "threshold")).alias("b")
    )
    return best.select(*by, F.col("b.threshold").alias("threshold"), F.col("b.tpr").alias("sens"), (1 - F.col("b.fpr")).alias("spec"))


def mean_threshold_compare(preds: DataFrame, run: str, fold: str, score: str = "p", default: float = 0.5) -> DataFrame:
    """Sensitivity and specificity at the default and at the run's mean fold threshold, mean and spread over folds."""
    # 12 places: the cut must not move with the order in which the folds are added up
    cut = youden_threshold(preds, [run, fold], score).groupBy(run).agg(
        F.round(F.avg("threshold"), 12).alias("mean_thr"), F.stddev_pop("threshold").alias("std_thr")
    )
    hist = score_histogram(preds, [run, fold], score).join(cut, run)

    def sums(at: Column, tag: str) -> list[Column]:
        hit = F.col(score) >= at
        return [
            F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias(f"tp_{tag}"),
            F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias(f"tn_{tag}"),
        ]

    per = hist.groupBy(run, fold).agg(
        F.first("mean_thr").alias("mean_thr"), F.first("std_thr").alias("std_thr"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), *sums(F.lit(default), "d"), *sums(F.col("mean_thr"), "y"),
    )
    for tag in ("d", "y"):
        per = per.withColumn(f"sens_{tag}", ratio(F.col(f"tp_{tag}"), F.col("p")))
        per = per.withColumn(f"spec_{tag}", ratio(F.col(f"tn_{tag}"), F.col("n")))
    names = ("sens_d", "spec_d", "sens_y", "spec_y")
    return per.groupBy(run).agg(
        F.first("mean_thr").alias("mean_thr"), F.first("std_thr").alias("std_thr"),
        *[a for m in names for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))],
    )


def metric_deltas(compare: DataFrame, base: str, new: str, name: str) -> DataFrame:
    """Difference and percent change, 0 percent where the base is (nearly) zero."""
    return compare.withColumns(
        {
            f"{name}_delta": F.col(new) - F.col(base),
            f"{name}_pct": F.when(F.col(base) > 1e-9, (F.col(new) - F.col(base)) / F.col(base) * 100).otherwise(0.0),
        }
    )


def threshold_sweep(preds: DataFrame, by: list[str], score: str = "p", floor: float = 0.70) -> DataFrame:
    """Sweep 0.05 .. 0.95 on pooled folds: best sensitivity with both rates >= floor, else best sens + spec - 1.

    Rows are first counted per number of thresholds passed (at most 20 rows per group), then expanded.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: i * 5 / F.lit(100.0))
    passed = F.size(F.filter(cuts, lambda c: F.col(score) >= c))
    counts = preds.groupBy(*by, passed.alias("passed")).agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    step = counts.select(*by, "passed", "pos", "neg", F.explode(F.sequence(F.lit(1), F.lit(19))).alias("i"))
    hit = F.col("passed") >= F.col("i")
    rates = step.groupBy(*by, "i").agg(
        ratio(F.sum(F.when(hit, F.col("pos")).otherwise(0)), F.sum("pos")).alias("sens"),
        ratio(F.sum(F.when(~hit, F.col("neg")).otherwise(0)), F.sum("neg")).alias("spec"),
    ).withColumn("ok", (F.col("sens") >= floor) & (F.col("spec") >= floor))
    goal = F.when(F.col("ok"), F.col("sens")).otherwise(F.col("sens") + F.col("spec") - 1)
    best = rates.groupBy(*by).agg(F.max_by(F.struct("i", "sens", "spec", "ok"), F.struct("ok", goal.alias("goal"), -F.col("i"))).alias("b"))
    return best.select(*by, (F.col("b.i") * 5 / F.lit(100.0)).alias("threshold"), "b.sens", "b.spec", F.col("b.ok").alias("meets_floor"))


def criteria_gate(summary: DataFrame, name: str, criteria: dict[str, float] | None = None) -> DataFrame:
    """Mark models that meet every floor; choose the best AUC among them, else the best AUC overall.

    ``summary`` has one row per model, so the single window partition stays small.
    """
    limits = criteria or CRITERIA
    ok = F.lit(True)
    for metric, least in limits.items():
        ok = ok & (F.col(f"{metric}_mean") >= least)
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("qualifies").desc(), F.col("auc_mean").desc(), F.col(name))
    return (
        summary.withColumn("qualifies", ok)
        .withColumn("any_pass", F.max("qualifies").over(every))
        .withColumn("chosen", F.row_number().over(order) == 1)
    )


def rank_runs(summary: DataFrame, within: str, run: str) -> DataFrame:
    order = Window.partitionBy(within).orderBy(F.col("auc_mean").desc(), F.col(run))
    return summary.withColumn("rank", F.row_number().over(order)).withColumn("best", F.col("rank") == 1)


def best_run_overall(summary: DataFrame, within: str, run: str) -> DataFrame:
    winners = rank_runs(summary, within, run).filter("best")
    return winners.orderBy(F.col("auc_mean").desc(), F.col(within), F.col(run)).limit(1)


def best_pair_strategy(summary: DataFrame, inputs: int = 2) -> DataFrame:
    """Keep the backbone of the best run on the last input; best strategy by mean AUC over all inputs."""
    lead = summary.filter(F.col("input") == inputs - 1).agg(
        F.max_by("backbone", F.struct("auc_mean", -F.col("run_no"))).alias("backbone")
    )
    pairs = summary.join(F.broadcast(lead), "backbone").groupBy("backbone", "strategy").agg(
        F.avg("auc_mean").alias("pair_auc"), F.count(F.lit(1)).alias("n")
    )
    return pairs.filter(F.col("n") == inputs).orderBy(F.col("pair_auc").desc(), "strategy").limit(1)


def best_fold(fold_auc: DataFrame, by: list[str], fold: str = "fold") -> DataFrame:
    """The first fold with the highest AUC."""
    best = fold_auc.filter(F.col("auc").isNotNull()).groupBy(*by).agg(
        F.max_by(F.struct(fold, "auc"), F.struct("auc", -F.col(fold))).alias("b")
    )
    return best.select(*by, F.col(f"b.{fold}").alias(fold), "b.auc")


def confident_examples(preds: DataFrame, by: list[str], score: str = "p", k: int = 4, hi: float = 0.7, lo: float = 0.3) -> DataFrame:
    """The k most confident correct samples per class; the row-number limit is applied before the shuffle too."""
    pos = preds.filter((F.col("y") == 1) & (F.col(score) >= hi))
    neg = preds.filter((F.col("y") == 0) & (F.col(score) <= lo))
    wp = Window.partitionBy(*by).orderBy(F.col(score).desc(), "sample_id")
    wn = Window.partitionBy(*by).orderBy(F.col(score).asc(), "sample_id")
    top = pos.withColumn("rn", F.row_number().over(wp)).filter(F.col("rn") <= k)
    low = neg.withColumn("rn", F.row_number().over(wn)).filter(F.col("rn") <= k)
    return top.unionByName(low)


def backfill_metric(stored: DataFrame, preds: DataFrame, run: str, fold: str, metric: str = "npv", score: str = "p") -> DataFrame:
    """Fill a metric missing from stored fold records out of the saved predictions; re-summarise every run."""
    lacking = stored.filter(F.col(metric).isNull()).select(run).distinct()
    fresh = binary_metrics(confusion_counts(preds.join(lacking, run, "left_semi"), [run, fold], score)).select(
        run, fold, F.col(metric).alias("__fresh")
    )
    filled = stored.join(fresh, [run, fold], "left").withColumn("updated", F.col("__fresh").isNotNull())
    return filled.groupBy(run).agg(
        F.avg(F.coalesce("__fresh", metric)).alias(f"{metric}_mean"),
        F.stddev_pop(F.coalesce("__fresh", metric)).alias(f"{metric}_std"),
        F.max("updated").alias("updated"),
    )


def run_grid(runs: DataFrame, dims: dict[str, list]) -> DataFrame:
    """Every expected combination, expanded from literal lists (no join)."""
    grid = runs.sparkSession.range(1).select(*[F.array(*map(F.lit, v)).alias(k) for k, v in dims.items()])
    for name in dims:
        grid = grid.withColumn(name, F.explode(name))
    return grid


def missing_runs(found: DataFrame, dims: dict[str, list]) -> DataFrame:
    return run_grid(found, dims).join(found.select(*dims).distinct(), list(dims), "left_anti")


def resume_runs(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return wanted.join(done.select(*key), key, "left_anti")


def run_progress(summary: DataFrame, within: str, run: str, expected: int) -> DataFrame:
    return summary.groupBy(within).agg(F.count_distinct(run).alias("completed")).withColumn("expected", F.lit(expected))


def best_combination(results: DataFrame, orders: list[str]) -> DataFrame:
    """Highest mean AUC rounded to 4 places, first in loop order. ``results`` is the small search table."""
    return results.withColumn("mean_auc4", F.bround("mean_auc", 4)).orderBy(F.col("mean_auc4").desc(), *orders).limit(1)
