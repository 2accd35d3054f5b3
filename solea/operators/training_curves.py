"""Training logs as event tables: early stopping, epoch averages and durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solea.functions.running import next_value, running
from solea.operators.case_tables import upsert_latest


def number_epochs(losses: DataFrame, run: str, order: list[str], slot: str) -> DataFrame:
    return running(losses, [run], slot, [F.col(c) for c in order], epoch=("count", F.lit(1)))


def early_stop(losses: DataFrame, run: str, order: list[str], loss: str, slot: str, patience: int) -> DataFrame:
    """Replay a loss series per run: strict improvement resets the counter, stop when it reaches ``patience``.

    The epoch of the running first minimum is the epoch of the last improvement, so the counter is a difference.
    """
    numbered = number_epochs(losses, run, order, slot)
    best = running(numbered, [run], slot, [F.col("epoch")], best=("min", F.struct(F.col(loss).alias("loss"), "epoch")))
    best = best.withColumn("waited", F.col("epoch") - F.col("best.epoch"))
    stops = best.groupBy(run).agg(
        F.min(F.when(F.col("waited") >= patience, F.col("epoch"))).alias("stop_epoch"), F.max("epoch").alias("last_epoch"),
        F.min_by("best", F.when(F.col("waited") >= patience, F.col("epoch"))).alias("at_stop"),
        F.max_by("best", "epoch").alias("at_end"),
    )
    chosen = F.when(F.col("stop_epoch").isNotNull(), F.col("at_stop")).otherwise(F.col("at_end"))
    return stops.select(
        run, "stop_epoch", chosen["epoch"].alias("best_epoch"), chosen["loss"].alias("best_loss"),
        F.coalesce("stop_epoch", "last_epoch").alias("epochs_used"),
    )


def avg_epochs(old: DataFrame, new: DataFrame, run: str, fold: str, version: str) -> DataFrame:
    """Merge stored and new fold epochs (new wins), then half-even rounded means of the non-null phases."""
    tag = lambda df, n: df.withColumn("__age", F.lit(n))
    merged = upsert_latest(tag(old, 0), tag(new, 1), [run, fold], ["__age", version])
    return merged.groupBy(run).agg(
        F.bround(F.avg("phase1"), 0).cast("int").alias("avg_phase1"), F.bround(F.avg("phase2"), 0).cast("int").alias("avg_phase2"),
        F.count(F.lit(1)).alias("n_folds"),
    )


def run_durations(events: DataFrame, run: str, ts: str, tie: str, slot: str) -> DataFrame:
    """Seconds to the next milestone of the same run; the last milestone is marked."""
    df = next_value(events, [run], slot, [F.col(ts), F.col(tie)], ts, "next_ts")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return df.withColumn("seconds", (us("next_ts") - us(ts)) / 1e6).withColumn("is_last", F.col("next_ts").isNull())
