"""Case collection queries on the event view."""

from __future__ import annotations

from pyspark.sql import functions as F

from solea.operators import case_tables as C
from solea.operators import training_curves as L
from solea.plans.registry import EXTRA_CHECK_VIEWS, Inputs, query

V = ["ts", "event_id"]
_LAST = "row_number() OVER (PARTITION BY {key} ORDER BY ts DESC, event_id DESC) AS rn"

EXTRA_CHECK_VIEWS.update({
    "crf_forms": f"""SELECT research_id, event_id, ts, props, 'nurse_' || CAST(event_id % 3 AS VARCHAR) AS nurse,
        CASE WHEN event_id % 5 < 4 THEN event_id % 5 END AS cat_l, CASE WHEN event_id // 5 % 5 < 4 THEN event_id // 5 % 5 END AS cat_r FROM (
        SELECT *, {_LAST.format(key='research_id')} FROM case_events WHERE action IN ('crf_save','crf_delete')) WHERE rn = 1 AND action = 'crf_save'""",
    "form_labels": """SELECT *, CASE WHEN cat_l >= 1 THEN 'Positive' WHEN cat_l = 0 THEN 'Negative' END AS label_l,
        CASE WHEN cat_r >= 1 THEN 'Positive' WHEN cat_r = 0 THEN 'Negative' END AS label_r FROM crf_forms""",
    "captures": f"""SELECT research_id, action AS modality, event_id, ts, 'raw/' || research_id || '_' || action || '_' || CAST(event_id AS VARCHAR) || '.png' AS raw_path FROM (
        SELECT *, {_LAST.format(key='research_id, action')} FROM case_events WHERE action IN ('podoscope','thermal')) WHERE rn = 1""",
    "commits": f"""SELECT research_id, event_id, ts AS committed_at FROM (SELECT *, {_LAST.format(key='research_id')} FROM case_events WHERE action = 'commit') WHERE rn = 1""",
    "prepro": "SELECT DISTINCT research_id FROM case_events WHERE action = 'podoscope' AND event_id % 7 = 0",
    "roi_rows": f"""SELECT research_id, event_id, event_id % 3 AS regions_l, event_id % 4 AS regions_r FROM (
        SELECT *, {_LAST.format(key='research_id')} FROM case_events WHERE action = 'commit' AND event_id % 2 = 0) WHERE rn = 1""",
    "flags": "SELECT research_id, bool_or(modality='podoscope') AS has_podo, bool_or(modality='thermal') AS has_thermal FROM captures GROUP BY research_id",
    "status_rows": """SELECT f.research_id, nurse, cat_l, cat_r, coalesce(has_podo,false) AS has_podo, coalesce(has_thermal,false) AS has_thermal
        FROM crf_forms f LEFT JOIN flags USING (research_id)""",
    "loss_rows": """SELECT *, row_number() OVER (PARTITION BY research_id ORDER BY ts, event_id) AS epoch, value AS loss FROM case_events""",
    "stop_rows": """SELECT *, epoch - max(CASE WHEN loss < coalesce(prev, 1e300) THEN epoch END) OVER (PARTITION BY research_id ORDER BY epoch) AS waited,
        max(CASE WHEN loss < coalesce(prev, 1e300) THEN epoch END) OVER (PARTITION BY research_id ORDER BY epoch) AS best_epoch,
        min(loss) OVER (PARTITION BY research_id ORDER BY epoch) AS best_loss FROM (
        SELECT *, min(loss) OVER (PARTITION BY research_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM loss_rows)""",
    "early_stop_rows": """SELECT research_id, s.stop_epoch, e.best_epoch, e.best_loss, e.epoch AS epochs_used FROM (
        SELECT research_id, min(CASE WHEN waited >= 5 THEN epoch END) AS stop_epoch, max(epoch) AS last_epoch FROM stop_rows GROUP BY research_id) s
        JOIN stop_rows e USING (research_id) WHERE e.epoch = coalesce(s.stop_epoch, s.last_epoch)""",
})


def forms(t: Inputs):
    saves = t.case_events.filter(F.col("action").isin("crf_save", "crf_delete"))
    keep = C.latest(saves, ["research_id"], V).filter(F.col("action") == "crf_save")
    part = F.floor(F.col("event_id") / 5) % 5
    return keep.select(
        "research_id", "event_id", "ts", "props", F.concat(F.lit("nurse_"), F.col("event_id") % 3).alias("nurse"),
        F.when(F.col("event_id") % 5 < 4, F.col("event_id") % 5).alias("cat_l"), F.when(part < 4, part).alias("cat_r"),
    )


def labelled_forms(t: Inputs):
    lab = lambda c: F.when(F.col(c) >= 1, "Positive").when(F.col(c) == 0, "Negative")
    return forms(t).withColumns({"label_l": lab("cat_l"), "label_r": lab("cat_r")})


def side_labels(t: Inputs):
    return labelled_forms(t).select("research_id", F.expr("stack(2, 'L', label_l, 'R', label_r) as (side, label)"))


def captures(t: Inputs):
    shots = t.case_events.filter(F.col("action").isin(*C.MODALITIES))
    rows = C.latest(shots, ["research_id", "action"], V)
    path = F.concat(F.lit("raw/"), "research_id", F.lit("_"), "action", F.lit("_"), F.col("event_id").cast("string"), F.lit(".png"))
    return rows.select("research_id", F.col("action").alias("modality"), "event_id", "ts", path.alias("raw_path"))


def commits(t: Inputs):
    rows = C.latest(t.case_events.filter(F.col("action") == "commit"), ["research_id"], V)
    return rows.select("research_id", "event_id", F.col("ts").alias("committed_at"))


def cases(t: Inputs):
    return t.case_events.groupBy("research_id").agg(F.min("ts").alias("created_at"))


def prepro(t: Inputs):
    return t.case_events.filter((F.col("action") == "podoscope") & (F.col("event_id") % 7 == 0))


def roi(t: Inputs):
    rows = C.latest(t.case_events.filter((F.col("action") == "commit") & (F.col("event_id") % 2 == 0)), ["research_id"], V)
    return rows.select("research_id", "event_id", (F.col("event_id") % 3).alias("regions_l"), (F.col("event_id") % 4).alias("regions_r"))


def status(t: Inputs):
    return C.case_status(cases(t), forms(t), captures(t))


@query("upsert_latest", "research_id:s modality:s event_id:i", "SELECT research_id, modality, event_id FROM captures")
def _(t):
    shots = t.case_events.filter(F.col("action").isin(*C.MODALITIES)).select("research_id", F.col("action").alias("modality"), *V)
    even = F.col("event_id") % 2 == 0
    return C.upsert_latest(C.latest(shots.filter(even), ["research_id", "modality"], V), shots.filter(~even), ["research_id", "modality"], V)


@query("insert_if_absent", "research_id:s event_id:i",
       """WITH a AS (SELECT research_id, event_id, row_number() OVER (PARTITION BY research_id ORDER BY ts, event_id) AS rn FROM case_events WHERE action='crf_save'),
          b AS (SELECT research_id, event_id, row_number() OVER (PARTITION BY research_id ORDER BY ts, event_id) AS rn FROM case_events WHERE action<>'crf_save')
          SELECT research_id, event_id FROM a WHERE rn=1 UNION ALL
          SELECT research_id, event_id FROM b WHERE rn=1 AND research_id NOT IN (SELECT research_id FROM a)""")
def _(t):
    ev = t.case_events.select("research_id", *V, "action")
    first = C.earliest(ev.filter("action = 'crf_save'"), ["research_id"], V)
    return C.insert_if_absent(first, ev.filter("action <> 'crf_save'"), ["research_id"], V)


@query("delete_by_key", "research_id:s outcome:s",
       """SELECT research_id, CASE WHEN research_id IN (SELECT research_id FROM commits) THEN 'deleted' ELSE 'absent' END AS outcome
            FROM (SELECT DISTINCT research_id FROM case_events WHERE action='crf_delete' AND event_id % 3 = 0)
          UNION ALL SELECT research_id, 'kept' FROM commits WHERE research_id NOT IN (SELECT research_id FROM case_events WHERE action='crf_delete' AND event_id % 3 = 0)""")
def _(t):
    kept, outcome = C.delete_by_key(commits(t), t.case_events.filter("action = 'crf_delete' AND event_id % 3 = 0"), ["research_id"])
    told = outcome.select("research_id", F.when(F.col("existed"), "deleted").otherwise("absent").alias("outcome"))
    return told.unionByName(kept.select("research_id", F.lit("kept").alias("outcome")))


_MIXED = """CASE event_id % 4 WHEN 0 THEN research_id WHEN 1 THEN concat(research_id, 'x') WHEN 2 THEN concat('X', research_id) ELSE 'P' END"""


@query("id_number", "event_id:i research_id:s id_no:i",
       f"""SELECT event_id, rid AS research_id, CAST(regexp_extract(rid, '^P([0-9]+)', 1) AS BIGINT) AS id_no
           FROM (SELECT event_id, {_MIXED} AS rid FROM case_events) WHERE regexp_matches(rid, '^P[0-9]')""")
def _(t):
    return C.id_number(t.case_events.select("event_id", F.expr(_MIXED).alias("research_id")))


@query("id_counters", "name:s top:i",
       " UNION ALL ".join(f"SELECT '{n}' AS name, coalesce(max(CAST(regexp_extract(research_id,'^P([0-9]+)',1) AS BIGINT)),0) AS top FROM {v}"
                          for n, v in (("commits", "commits"), ("forms", "crf_forms"), ("cases", "case_events"))))
def _(t):
    return C.id_counters(commits=commits(t), forms=forms(t), cases=cases(t))


@query("import_counts", "name:s n:i",
       """SELECT 'cases' AS name, count(DISTINCT research_id) AS n FROM case_events UNION ALL SELECT 'crf_forms', count(*) FROM crf_forms
          UNION ALL SELECT 'captures', count(*) FROM captures UNION ALL SELECT 'preprocessing', count(*) FROM prepro
          UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'roi_annotations', count(*) FROM roi_rows
          UNION ALL SELECT 'nurses', count(DISTINCT nurse) FROM crf_forms""")
def _(t):
    return C.table_counts(cases=cases(t), crf_forms=forms(t), captures=captures(t), preprocessing=prepro(t).select("research_id").distinct(),
                          commits=commits(t), roi_annotations=roi(t), nurses=forms(t).select("nurse").distinct())


@query("enum_check", "event_id:i violates:s",
       """SELECT event_id, concat_ws(',', CASE WHEN action NOT IN ('podoscope','thermal') THEN 'modality' END,
            CASE WHEN event_id % 3 = 2 THEN 'side' END) AS violates FROM case_events WHERE action NOT IN ('podoscope','thermal') OR event_id % 3 = 2""")
def _(t):
    side = F.element_at(F.array(F.lit("L"), F.lit("R"), F.lit("X")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = t.case_events.select("event_id", F.col("action").alias("modality"), side.alias("side"))
    return C.enum_violations(rows, modality=C.MODALITIES, side=C.SIDES)


_STATUS = "research_id:s nurse:s cat_l:i cat_r:i has_podo:b has_thermal:b"


@query("case_status", _STATUS, "SELECT * FROM status_rows")
def _(t):
    return status(t).orderBy("research_id")


@query("pending_cases", _STATUS,
       """SELECT f.research_id, nurse, cat_l, cat_r, coalesce(has_podo,false) AS has_podo, coalesce(has_thermal,false) AS has_thermal
          FROM crf_forms f LEFT JOIN (SELECT research_id, bool_or(modality='podoscope') AS has_podo, bool_or(modality='thermal') AS has_thermal
            FROM captures JOIN (SELECT research_id, ts AS saved FROM crf_forms) USING (research_id) WHERE ts >= saved GROUP BY research_id) USING (research_id)
          WHERE NOT (coalesce(has_podo,false) AND coalesce(has_thermal,false))""")
def _(t):
    """A form saved again asks for captures taken since."""
    since = captures(t).join(forms(t).select("research_id", F.col("ts").alias("saved")), "research_id").filter("ts >= saved").drop("saved")
    return C.pending_cases(C.case_status(cases(t), forms(t), since))


@query("roi_ready", _STATUS, "SELECT * FROM status_rows WHERE has_podo AND has_thermal")
def _(t):
    return C.roi_ready(status(t))


@query("commit_manifest", "research_id:s event_id:i podo_raw:s podo_prepro:s thermal:s status:s captured_at:s",
       """SELECT c.research_id, c.event_id, CASE WHEN p.ts IS NOT NULL AND h.ts IS NOT NULL THEN 'complete' WHEN p.ts IS NOT NULL OR h.ts IS NOT NULL THEN 'partial' ELSE 'rejected' END AS status,
            CAST(epoch_us(greatest(p.ts, h.ts)) AS BIGINT) AS captured_at, coalesce(p.raw_path,'') AS podo_raw, CASE WHEN r.research_id IS NULL THEN '' ELSE 'yes' END AS podo_prepro,
            coalesce(h.raw_path,'') AS thermal FROM commits c LEFT JOIN captures p ON p.research_id=c.research_id AND p.modality='podoscope'
          LEFT JOIN captures h ON h.research_id=c.research_id AND h.modality='thermal' LEFT JOIN prepro r ON r.research_id=c.research_id""")
def _(t):
    return C.commit_manifest(commits(t), captures(t), prepro(t)).withColumn("captured_at", F.unix_micros(F.col("captured_at").cast("timestamp")))


@query("commit_status", "research_id:s event_id:i status:s",
       """SELECT c.research_id, c.event_id, CASE WHEN coalesce(has_podo,false) AND coalesce(has_thermal,false) THEN 'complete'
            WHEN coalesce(has_podo,false) OR coalesce(has_thermal,false) THEN 'partial' ELSE 'rejected' END AS status
          FROM commits c LEFT JOIN (SELECT research_id, bool_or(modality='podoscope') AS has_podo, bool_or(modality='thermal') AS has_thermal
            FROM captures GROUP BY research_id) USING (research_id)""")
def _(t):
    return C.commit_status(commits(t), captures(t))


@query("form_list_view", "research_id:s captured:b regions_l:i regions_r:i state_l:s state_r:s",
       """SELECT f.research_id, c.research_id IS NOT NULL AS captured, coalesce(regions_l,0) AS regions_l, coalesce(regions_r,0) AS regions_r,
            CASE WHEN label_l='Negative' THEN 'not_needed' WHEN coalesce(regions_l,0)>0 THEN 'done' ELSE 'pending' END AS state_l,
            CASE WHEN label_r='Negative' THEN 'not_needed' WHEN coalesce(regions_r,0)>0 THEN 'done' ELSE 'pending' END AS state_r
          FROM form_labels f LEFT JOIN commits c USING (research_id) LEFT JOIN roi_rows r USING (research_id)""")
def _(t):
    return C.form_list_view(labelled_forms(t), commits(t), roi(t).drop("event_id"))


@query("roi_state", "research_id:s side:s state:s",
       """SELECT research_id, side, CASE WHEN label='Negative' THEN 'not_needed' WHEN n>0 THEN 'done' ELSE 'pending' END AS state FROM (
            SELECT research_id, 'L' AS side, label_l AS label, event_id % 3 AS n FROM form_labels UNION ALL SELECT research_id, 'R', label_r, event_id % 2 FROM form_labels)""")
def _(t):
    rows = labelled_forms(t).select("research_id", F.expr("stack(2, 'L', label_l, event_id % 3, 'R', label_r, event_id % 2) as (side, label, n)"))
    return rows.withColumn("state", C.roi_side_state(F.col("label"), F.col("n")))


@query("capture_gate", "event_id:i research_id:s accepted:b",
       """SELECT event_id, research_id, research_id IN (SELECT research_id FROM crf_forms) AS accepted FROM case_events WHERE action IN ('podoscope','thermal')""")
def _(t):
    yes, no = C.capture_gate(t.case_events.filter(F.col("action").isin(*C.MODALITIES)), forms(t))
    return yes.withColumn("accepted", F.lit(True)).unionByName(no.withColumn("accepted", F.lit(False)))


@query("delete_guard", "research_id:s blocked:b",
       "SELECT research_id, research_id IN (SELECT research_id FROM captures) AS blocked FROM crf_forms")
def _(t):
    free, blocked = C.delete_guard(forms(t), captures(t))
    return free.withColumn("blocked", F.lit(False)).unionByName(blocked.withColumn("blocked", F.lit(True)))


@query("orphan_rows", "research_id:s child:s n:i",
       """WITH p AS (SELECT DISTINCT research_id FROM case_events WHERE CAST(substr(research_id,2) AS INT) % 10 <> 0)
          SELECT research_id, 'captures' AS child, count(*) AS n FROM captures WHERE research_id NOT IN (FROM p) GROUP BY 1
          UNION ALL SELECT research_id, 'commits', count(*) FROM commits WHERE research_id NOT IN (FROM p) GROUP BY 1
          UNION ALL SELECT research_id, 'crf_forms', count(*) FROM crf_forms WHERE research_id NOT IN (FROM p) GROUP BY 1""")
def _(t):
    parents = cases(t).filter(F.substring("research_id", 2, 20).cast("int") % 10 != 0)
    return C.orphan_rows(parents, captures=captures(t), commits=commits(t), crf_forms=forms(t))


_NEED = """SELECT i.research_id, s.side FROM (SELECT DISTINCT research_id FROM case_events) i, (SELECT unnest(['L','R']) AS side) s
  LEFT JOIN (SELECT research_id, 'L' AS side, label_l AS label FROM form_labels UNION ALL SELECT research_id, 'R', label_r FROM form_labels) f
  ON f.research_id=i.research_id AND f.side=s.side WHERE coalesce(label,'') <> 'Negative'"""


@query("needed_sides", "research_id:s side:s", _NEED)
def _(t):
    return C.needed_sides(cases(t), side_labels(t))


@query("sides_to_add", "research_id:s side:s",
       f"""{_NEED} EXCEPT SELECT research_id, unnest(CASE WHEN regions_l > 0 AND regions_r > 0 THEN ['L','R'] WHEN regions_l > 0 THEN ['L']
           WHEN regions_r > 0 THEN ['R'] ELSE [] END) FROM roi_rows""")
def _(t):
    drawn = roi(t).select("research_id", F.expr("stack(2, 'L', regions_l, 'R', regions_r) as (side, n)")).filter("n > 0")
    return C.sides_to_add(C.needed_sides(cases(t), side_labels(t)), drawn)


@query("manifest_display", "research_id:s status:s podo:b prepro:b ther:b",
       """SELECT c.research_id, CASE WHEN c.event_id % 2 = 0 THEN 'nested' ELSE 'flat' END AS status, p.research_id IS NOT NULL AS podo,
            r.research_id IS NOT NULL AS prepro, h.research_id IS NOT NULL AS ther
          FROM commits c LEFT JOIN captures p ON p.research_id=c.research_id AND p.modality='podoscope'
          LEFT JOIN captures h ON h.research_id=c.research_id AND h.modality='thermal' LEFT JOIN prepro r ON r.research_id=c.research_id""")
def _(t):
    m = C.commit_manifest(commits(t), captures(t), prepro(t))
    nested = m.filter("event_id % 2 = 0").select(
        "research_id", F.lit("nested").alias("status"),
        F.struct(F.expr("nullif(podo_raw, '')").alias("raw"), F.when(F.col("podo_prepro") == "yes", F.create_map(F.lit("L"), F.lit("x"))).alias("preprocessing")).alias("podoscope"),
        F.struct(F.expr("nullif(thermal, '')").alias("image")).alias("thermal"),
    )
    return C.manifest_display(nested, m.filter("event_id % 2 <> 0").withColumn("status", F.lit("flat")))


@query("summary_projection", "research_id:s saved_at:i region_count_l:i",
       "SELECT research_id, event_id AS saved_at, regions_l AS region_count_l FROM roi_rows")
def _(t):
    stored = roi(t).select(
        "research_id", F.col("event_id").alias("saved_at"),
        F.create_map(F.lit("L"), F.struct(F.col("regions_l").alias("region_count"))).alias("summary"), F.lit("{}").alias("project"),
    )
    return C.summary_projection(stored).withColumn("region_count_l", F.col("summary")["L"]["region_count"])


@query("newest_forms", "research_id:s event_id:i", "SELECT research_id, event_id FROM crf_forms ORDER BY research_id DESC")
def _(t):
    return forms(t).orderBy(F.col("research_id").desc())


@query("recent_commits", "research_id:s event_id:i", "SELECT research_id, event_id FROM commits ORDER BY committed_at DESC")
def _(t):
    return commits(t).orderBy(F.col("committed_at").desc(), "research_id")


@query("json_fields", "event_id:i k:i missing:s",
       "SELECT event_id, coalesce(CAST(json_extract_string(props,'$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props,'$.none'), '') AS missing FROM case_events")
def _(t):
    parsed = F.from_json("props", "k BIGINT, none STRING")
    return t.case_events.select("event_id", F.coalesce(parsed["k"], F.lit(0)).alias("k"), F.coalesce(parsed["none"], F.lit("")).alias("missing"))


@query("iso_timestamp", "event_id:i text:s utc_seconds:i",
       """SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S') || '+07:00' AS text, epoch_us(date_trunc('second', ts)) // 1000000 AS utc_seconds FROM case_events""")
def _(t):
    rows = t.case_events.select("event_id", C.iso_local(F.col("ts").cast("timestamp")).alias("text"))
    return rows.withColumn("utc_seconds", F.unix_seconds(C.iso_to_utc(F.col("text"))))


def losses(t: Inputs):
    return t.case_events.select("research_id", *V, F.col("value").alias("loss"), F.date_trunc("hour", "ts").alias("slot"))


@query("early_stop", "research_id:s stop_epoch:i best_epoch:i best_loss:f epochs_used:i", "SELECT * FROM early_stop_rows")
def _(t):
    return L.early_stop(losses(t), "research_id", V, "loss", "slot", 5)


@query("avg_epochs", "research_id:s avg_phase1:i avg_phase2:i n_folds:i",
       """WITH e AS (SELECT research_id, event_id % 5 AS fold, event_id % 50 + 1 AS phase1, CASE WHEN event_id % 3 <> 0 THEN event_id % 30 + 1 END AS phase2,
            CASE WHEN action='commit' THEN 0 ELSE 1 END AS age, event_id FROM case_events WHERE action IN ('commit','crf_save')),
          m AS (SELECT *, row_number() OVER (PARTITION BY research_id, fold ORDER BY age DESC, event_id DESC) AS rn FROM e)
          SELECT research_id, CAST(round_even(avg(phase1),0) AS INT) AS avg_phase1, CAST(round_even(avg(phase2),0) AS INT) AS avg_phase2, count(*) AS n_folds
          FROM m WHERE rn=1 GROUP BY research_id""")
def _(t):
    rows = t.case_events.select(
        "research_id", "action", (F.col("event_id") % 5).alias("fold"), (F.col("event_id") % 50 + 1).alias("phase1"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 30 + 1).alias("phase2"), "event_id",
    )
    return L.avg_epochs(rows.filter("action = 'commit'"), rows.filter("action = 'crf_save'"), "research_id", "fold", "event_id")


@query("run_durations", "event_id:i seconds:f is_last:b",
       """SELECT event_id, (epoch_us(n) - epoch_us(ts))/1e6 AS seconds, n IS NULL AS is_last FROM (
            SELECT *, lead(ts) OVER (PARTITION BY research_id ORDER BY ts, event_id) AS n FROM case_events)""")
def _(t):
    ev = t.case_events.withColumn("slot", F.date_trunc("hour", "ts"))
    return L.run_durations(ev, "research_id", "ts", "event_id", "slot")
