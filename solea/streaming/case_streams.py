"""The case workflow as Structured Streaming jobs over an append stream of actions ``(event_id, ts, research_id, action, value)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from solea.operators.case_tables import MODALITIES, latest
from solea.session import new_folder
from solea.views import VIEWS


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The event table as a stream of case actions. Event time becomes a zoned timestamp for watermarks."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    source, text, _ = VIEWS["case_events"]
    if not _is_folder(spark, path):  # a stream source is a folder; a single file is picked out of its folder by name
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    return spark.sql(text, **{source: reader.parquet(path)}).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, label: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream over all available input; every batch overwrites its own folder, so a repeated batch adds nothing.

    A later run with the same ``checkpoint`` and ``out`` goes on where the last one ended.
    """
    spark = stream.sparkSession
    out = out or new_folder(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_no={batch_id}")

    job = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or new_folder(spark, f"{label}-progress"))
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    job.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_no", T.LongType())])
    return spark.read.schema(schema).parquet(out)


def audit_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Actions per time window; rows later than the watermark are dropped."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", lateness).groupBy(win, "action").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Activity sessions per case."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "research_id").agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, horizon: str = "60 days") -> DataFrame:
    """At most one row per case id within the horizon."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["research_id"])


def in_event_order(events: DataFrame, columns: dict[str, str], carry: dict[str, str], start: tuple, step: Callable, result: str, lateness: str,
                   finished: Callable[[tuple], bool] | None = None, forget: str = "30 days") -> DataFrame:
    """Replay the rows of each case in order of (ts, event_id), whatever order they arrive in.

    Rows wait in the case's state until the watermark has passed them: only then can nothing come before them any more. An event-time timer of the case
    wakes it when its next row is final, also when no new row arrives. ``step(carry, rows)`` gets final rows (columns ``us``, ``event_id`` and ``columns``)
    and returns the new carry, a list of result rows and how many rows it has used. State holds the carry and the rows of the last ``lateness``. A case that is ``finished``
    takes no rows; once it has had none for ``forget`` its state is dropped, and a later row starts it anew.
    """
    held = {"us": "bigint", "event_id": "bigint", **columns}
    state_type = ", ".join([*(f"{c} {k}" for c, k in carry.items()), "last bigint", *(f"rows_{c} array<{k}>" for c, k in held.items())])
    names, width = result_names(result), len(carry)
    wait = events.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {forget})")).first()[0] // 1000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = tuple(state.get) if state.exists else (*start, 0, *([] for _ in held))
        own, last, pending = kept[:width], kept[width], [list(c) for c in kept[width + 1 :]]
        if not state.hasTimedOut:
            for pdf in batches:
                for values, c in zip(pending, held):
                    values.extend(pdf[c].tolist())
        now = state.getCurrentWatermarkMs()
        rows = pd.DataFrame(dict(zip(held, pending)), columns=list(held)).sort_values(["us", "event_id"], kind="stable")
        final = rows["us"] <= (now - 1) * 1000  # a timer goes off when the watermark is beyond it
        ready, rest = rows[final], rows[~final]
        made, left = [], ready
        while len(left):
            if finished is not None and finished(own):  # nothing more until the case has been silent for so long
                silent = np.flatnonzero(left["us"].diff().fillna(left["us"] - last) > wait * 1000)
                last, left = int(left["us"].iloc[silent[0] - 1 if len(silent) else -1]), left.iloc[silent[0] if len(silent) else len(left) :]
                own = start if len(silent) else own
            else:
                own, out, used = step(own, left)
                made, last, left = made + out, int(left["us"].iloc[used - 1]), left.iloc[used:]
        if made:
            yield pd.DataFrame([(key[0], *r) for r in made], columns=names)
        over = finished is not None and finished(own)
        if over and not len(rest) and now > last // 1000 + wait:
            state.remove()
            return
        state.update((*own, last, *(rest[c].tolist() for c in held)))
        if len(rest):
            state.setTimeoutTimestamp(max(-(-int(rest["us"].iloc[0]) // 1000), now + 1))
        elif over:
            state.setTimeoutTimestamp(max(last // 1000 + wait, now + 1))

    timed = events.withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts")).select("research_id", "ts", *held)
    return timed.groupBy("research_id").applyInPandasWithState(
        lambda key, batches, state: run(key, batches, state), result, state_type, "append", GroupStateTimeout.EventTimeTimeout)


def result_names(result: str) -> list[str]:
    return [c.split()[0] for c in result.split(",")]


def capture_gate(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Capture events marked by whether their case had a form at that time: saved before and not deleted since."""

    def step(carry: tuple, rows: pd.DataFrame) -> tuple[tuple, list, int]:
        form = rows["action"].map({"crf_save": 1.0, "crf_delete": 0.0}).ffill().fillna(float(carry[0]))
        shots = rows["action"].isin(MODALITIES)
        return (bool(form.iloc[-1]),), list(zip(rows["event_id"][shots], form[shots] > 0)), len(rows)

    told = events.filter(F.col("action").isin("crf_save", "crf_delete", *MODALITIES))
    return in_event_order(told, {"action": "string"}, {"has_form": "boolean"}, (False,), step, "research_id string, event_id bigint, accepted boolean", lateness)


_POINTER = "batch bigint, merged bigint, base int"
_STATE = "research_id string, kind string, ts timestamp, event_id bigint, action string"
_KEY, _VERSION = ["research_id", "kind"], ["ts", "event_id"]


def _pointer(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Last batch, last batch that is in the base, and which base; the newer of two slots that are written in turn."""
    found = [(-1, -1, -1)]
    for slot in (0, 1):
        try:
            found += [tuple(r) for r in spark.read.schema(_POINTER).parquet(f"{path}/pointer/{slot}").collect()]
        except AnalysisException:  # not written yet
            pass
    return max(found)


def _layers(spark: SparkSession, path: str, at: tuple[int, int, int], merge_every: int) -> DataFrame:
    """The base and the deltas that are not in it yet: one row for each case and kind after ``latest``."""
    batch, merged, base = at
    parts = ([f"{path}/base/{base}"] if base >= 0 else []) + [f"{path}/delta/{b % merge_every}" for b in range(merged + 1, batch + 1)]
    rows = spark.read.schema(_STATE).parquet(*parts) if parts else spark.createDataFrame([], _STATE)
    return latest(rows, _KEY, _VERSION)


def merge_batch(batch: DataFrame, batch_id: int, path: str, merge_every: int = 8) -> None:
    """Add a batch of case events to the state in ``path``.

    A batch becomes one reduced delta; every ``merge_every`` batches the deltas go into the other of two bases. The pointer is
    written last, so a batch that breaks off leaves the state as it was, and a batch that is repeated changes nothing.
    """
    spark = batch.sparkSession
    at = last, merged, base = _pointer(spark, path)
    if batch_id <= last:
        return
    kind = F.when(F.col("action").startswith("crf_"), "form").otherwise(F.col("action"))
    reduced = latest(batch.select("research_id", kind.alias("kind"), "ts", "event_id", "action"), _KEY, _VERSION)
    reduced.write.mode("overwrite").parquet(f"{path}/delta/{batch_id % merge_every}")
    at = (batch_id, merged, base)
    if batch_id - merged == merge_every:
        _layers(spark, path, at, merge_every).write.mode("overwrite").parquet(f"{path}/base/{max(base, 0) ^ 1}")
        at = (batch_id, batch_id, max(base, 0) ^ 1)
    spark.createDataFrame([at], _POINTER).coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer/{batch_id % 2}")


def read_case_state(spark: SparkSession, path: str, merge_every: int = 8) -> DataFrame:
    """Latest-wins state per case. A read takes the base and at most ``merge_every`` deltas, however many batches there were."""
    state = _layers(spark, path, _pointer(spark, path), merge_every)
    has = lambda k: F.bool_or(F.col("kind") == k)
    per = state.groupBy("research_id").agg(
        F.bool_or((F.col("kind") == "form") & (F.col("action") == "crf_save")).alias("has_form"),
        has("podoscope").alias("has_podo"), has("thermal").alias("has_thermal"), has("commit").alias("committed"),
    )
    status = F.when(~F.col("committed"), "open").when(F.col("has_podo") & F.col("has_thermal"), "complete").when(
        F.col("has_podo") | F.col("has_thermal"), "partial").otherwise("rejected")
    return per.withColumn("status", status)


def case_state(events: DataFrame, path: str | None = None, merge_every: int = 8) -> DataFrame:
    """Run the stream over all available input and read the state; progress is kept beside the state, so a later run goes on."""
    spark = events.sparkSession
    path = path or new_folder(spark, "case-state")
    job = events.writeStream.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(
        lambda batch, batch_id: merge_batch(batch, batch_id, path, merge_every)).start()
    job.awaitTermination()
    return read_case_state(spark, path, merge_every)


def early_stop_events(losses: DataFrame, patience: int, lateness: str = "10 minutes", forget: str = "365 days") -> DataFrame:
    """One event per run when its loss has not improved for ``patience`` epochs; epochs are numbered by time, not by arrival."""

    def step(carry: tuple, rows: pd.DataFrame) -> tuple[tuple, list, int]:
        epoch, best, best_epoch, done = carry
        for used, loss in enumerate(rows["loss"], 1):
            epoch += 1
            if loss < best:
                best, best_epoch = float(loss), epoch
            elif epoch - best_epoch >= patience:
                return (epoch, best, best_epoch, True), [(epoch, best_epoch, best)], used
        return (epoch, best, best_epoch, done), [], len(rows)

    carry = {"epoch": "int", "best": "double", "best_epoch": "int", "done": "boolean"}
    return in_event_order(losses, {"loss": "double"}, carry, (0, float("inf"), 0, False), step,
                          "research_id string, stop_epoch int, best_epoch int, best_loss double", lateness, lambda c: c[3], forget)
