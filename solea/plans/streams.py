"""Streaming queries over the event table, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from solea.operators.case_tables import latest
from solea.plans.registry import Inputs, query
from solea.session import new_folder
from solea.streaming import case_streams as S


def stream(t: Inputs):
    return S.event_stream(t.spark, f"{t.sf_dir}/events.parquet")


def _newest(df, key):
    """Update-mode output holds one row per batch that touched a key; the last one counts."""
    return latest(df, key, ["batch_no"])


@query("stream_audit_counts", "hour:i action:s n:i", "SELECT epoch_us(date_trunc('hour', ts)) // 3600000000 AS hour, action, count(*) AS n FROM case_events GROUP BY 1, 2")
def _(t):
    rows = _newest(S.drain(S.audit_counts(stream(t)), "update", "audit"), ["window", "action"])
    return rows.withColumn("hour", F.floor(F.unix_seconds("window.start") / 3600))


@query("stream_audit_sliding", "half_hour:i action:s n:i",
       """SELECT (epoch_us(ts) // 1800000000) - k AS half_hour, action, count(*) AS n FROM case_events, (SELECT unnest([0,1]) AS k) GROUP BY 1, 2""")
def _(t):
    rows = _newest(S.drain(S.audit_counts(stream(t), "1 hour", "30 minutes"), "update", "sliding"), ["window", "action"])
    return rows.withColumn("half_hour", F.floor(F.unix_seconds("window.start") / 1800))


@query("stream_sessions", "research_id:s start_us:i end_us:i n:i",
       """WITH g AS (SELECT research_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM case_events WINDOW w AS (PARTITION BY research_id ORDER BY ts)),
          s AS (SELECT research_id, ts, sum(fresh) OVER (PARTITION BY research_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
          SELECT research_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY research_id, no
          HAVING epoch_us(max(ts)) + 1800000000 <= (SELECT epoch_us(max(ts)) FROM case_events) - 600000000""")
def _(t):
    """Sessions are final once the watermark has passed their end, so the last ten minutes stay open."""
    rows = S.drain(S.sessions(stream(t)), "append", "sessions")
    us = lambda c: F.unix_micros(F.col(f"session_window.{c}"))
    return rows.withColumns({"start_us": us("start"), "end_us": us("end")})


@query("stream_dedupe", "research_id:s", "SELECT DISTINCT research_id FROM case_events")
def _(t):
    return S.drain(S.first_seen(stream(t)).select("research_id", "ts"), "append", "dedupe")


def _slices(t: Inputs, n: int = 3):
    """The raw events as they arrive: n parts one after the other, a row up to nine minutes after its time, so that neighbours change places."""
    events = t.table("events").withColumn("came", F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 10 * 60_000_000)
    ends = events.select(F.col("came").cast("double")).approxQuantile("came", [k / n for k in range(1, n)], 0.001)
    for low, high in zip([None, *ends], [*ends, None]):
        part = events if low is None else events.where(F.col("came") > low)
        yield (part if high is None else part.where(F.col("came") <= high)).drop("came")


def over_slices(t: Inputs, run):
    """Add the slices to a folder one by one and run the stream after each; the last run's result counts."""
    path = new_folder(t.spark, "arrivals")
    for part in _slices(t):
        part.write.mode("append").parquet(path)
        result = run(S.event_stream(t.spark, path))
    return result


def drained(t: Inputs, build, mode: str, label: str):
    out, progress = new_folder(t.spark, label), new_folder(t.spark, f"{label}-progress")
    return over_slices(t, lambda events: S.drain(build(events), mode, label, progress, out))


# a row is final when its time, rounded up to milliseconds, is below the watermark: the newest time less ten minutes
_FINAL = "(epoch_us(ts) + 999) // 1000 < (SELECT epoch_us(max(ts)) // 1000 FROM {source}) - 600000"


@query("stream_capture_gate", "event_id:i accepted:b",
       f"""SELECT event_id, coalesce(form, false) AS accepted FROM (SELECT *, last_value(CASE action WHEN 'crf_save' THEN true WHEN 'crf_delete' THEN false END IGNORE NULLS) OVER (
            PARTITION BY research_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS form FROM case_events WHERE action <> 'commit') WHERE action IN ('podoscope','thermal')
            AND {_FINAL.format(source="case_events WHERE action <> 'commit'")}""")
def _(t):
    """A capture counts only if its case has a form at that time; the last ten minutes are not final yet."""
    return drained(t, S.capture_gate, "append", "gate")


@query("stream_case_state", "research_id:s has_form:b has_podo:b has_thermal:b status:s",
       """SELECT research_id, research_id IN (SELECT research_id FROM crf_forms) AS has_form, p AS has_podo, h AS has_thermal,
            CASE WHEN NOT c THEN 'open' WHEN p AND h THEN 'complete' WHEN p OR h THEN 'partial' ELSE 'rejected' END AS status FROM (
            SELECT research_id, bool_or(action='podoscope') AS p, bool_or(action='thermal') AS h, bool_or(action='commit') AS c FROM case_events GROUP BY research_id)""")
def _(t):
    path = new_folder(t.spark, "case-state")
    return over_slices(t, lambda events: S.case_state(events, path, merge_every=2))


@query("stream_early_stop", "research_id:s stop_epoch:i best_epoch:i best_loss:f",
       f"""SELECT research_id, stop_epoch, best_epoch, best_loss FROM early_stop_rows JOIN (SELECT research_id, epoch AS stop_epoch FROM loss_rows WHERE {_FINAL.format(source="case_events")})
            USING (research_id, stop_epoch)""")
def _(t):
    losses = lambda events: events.select("research_id", "ts", "event_id", F.col("value").alias("loss"))
    return drained(t, lambda events: S.early_stop_events(losses(events), 5), "append", "stops")
