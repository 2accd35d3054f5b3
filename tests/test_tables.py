"""Case tables, sources and streams on small literal inputs."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from solea.functions.running import next_value, running
from solea.operators import case_tables as C
from solea.operators import thermal as T
from solea.plans import QUERIES
from solea.session import shared_dir
from solea.sources import case_dumps as D
from solea.sources import images as I
from solea.sources import matrices as R
from solea.sources import packs as K
from solea.streaming import case_streams as S


def test_upsert_takes_the_last_duplicate_in_a_batch(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 2, "y"), ("a", 3, "z"), ("c", 1, "n")], "k string, v int, t string")
    assert {r.k: r.t for r in C.upsert_latest(old, new, ["k"], ["v"]).collect()} == {"a": "z", "b": "x", "c": "n"}
    assert {r.k: r.t for r in C.insert_if_absent(old, new, ["k"], ["v"]).collect()} == {"a": "x", "b": "x", "c": "n"}


def test_id_numbers_parse_leniently(spark):
    df = spark.createDataFrame([("P0012",), ("P12x",), ("Px",), ("Q1",), ("P",)], "research_id string")
    assert sorted((r.research_id, r.id_no) for r in C.id_number(df).collect()) == [("P0012", 12), ("P12x", 12)]
    assert {r.name: r.top for r in C.id_counters(a=df, b=df.filter("false")).collect()} == {"a": 12, "b": 0}


def test_iso_text_round_trip(spark):
    ts = F.lit("2024-01-31 20:00:00.9").cast("timestamp")
    text, back = spark.range(1).select(C.iso_local(ts), F.unix_seconds(C.iso_to_utc(C.iso_local(ts)))).first()
    assert text == "2024-02-01T03:00:00+07:00"
    assert back == int(dt.datetime(2024, 1, 31, 20, tzinfo=dt.timezone.utc).timestamp())


def test_running_values_do_not_depend_on_slots(spark):
    rows = [("hot", i, (i * 37) % 11) for i in range(60)] + [("b", i, i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, i int, v int").withColumn("slot", F.floor(F.col("i") / 7))
    got = {(r.g, r.i): (r.s, r.m, r.n) for r in running(df, ["g"], "slot", [F.col("i")], s=("sum", F.col("v")), m=("min", F.col("v")), n=("count", F.lit(1))).collect()}
    for g in ("hot", "b"):
        vs = [v for k, _, v in rows if k == g]
        assert all(got[(g, i)] == (sum(vs[: i + 1]), min(vs[: i + 1]), i + 1) for i in range(len(vs)))
    ahead = {(r.g, r.i): r.nv for r in next_value(df, ["g"], "slot", [F.col("i")], "v", "nv").collect()}
    assert ahead[("hot", 6)] == 7 * 37 % 11 and ahead[("hot", 59)] is None


def test_empty_zone_gives_zeros(spark):
    images = spark.createDataFrame([(1, 1, "L", "F"), (2, 1, "R", "M")], "image_id int, subject int, foot string, gender string")
    temps = spark.createDataFrame([(1, "FullFoot", 30.5), (1, "FullFoot", 0.0), (2, "LPA", 0.0)], "image_id int, zone string, temp double")
    people = spark.createDataFrame([(9, "F", 1.0, 1.0, 1.0)], "subject int, gender string, age double, tci_l double, tci_r double")
    rows = {r.image_id: r for r in T.feature_matrix(images, temps, people).collect()}
    assert rows[1].FullFoot_ET == 30.5 and rows[1].FullFoot_ETD == 30.5 and rows[1].NTR_Class3 == 1.0 and rows[1].Gender == 1.0
    assert rows[2].FullFoot_Mean == 0.0 and rows[2].FullFoot_ETD == 30.5 and rows[2].LPA_SD == 0.0


@pytest.mark.parametrize("temp,cls", [(26.0, 0), (27.5, 0), (30.75, 3), (33.0, 5), (40.0, 7)])
def test_nearest_class_prefers_the_lower_index(spark, temp, cls):
    assert spark.range(1).select(T.nearest_class(F.lit(temp))).first()[0] == cls


def test_documents_good_and_bad(spark, tmp_path):
    (tmp_path / "P0001.json").write_text('{"nurse": "nurse_a", "data": {"fields": {"ckd": "no"}}}')
    (tmp_path / "P0002.json").write_text('{"pid": "P7", "schema_version": "2.0"}')
    (tmp_path / "P0003.json").write_text('{"pid": ')
    good, bad = D.import_forms(D.read_documents(spark, str(tmp_path)))
    assert {r.research_id: (r.nurse, r.schema_version) for r in good.collect()} == {"P0001": ("nurse_a", "1.0"), "P7": ("", "2.0")}
    assert [r.stem for r in bad.collect()] == ["P0003"]


def test_commit_documents_and_manifest(spark, tmp_path):
    docs = spark.createDataFrame([("P1", '{"research_id":"P1","captured_at":"t","podoscope":{"raw":"a.png","preprocessing":{"L":"l.png"}},"thermal":{"image":null}}')], "stem string, value string")
    parts = D.import_commits(docs)
    assert [r.modality for r in parts["captures"].collect()] == ["podoscope"] and parts["preprocessing"].first().side == "L"
    (tmp_path / "m.csv").write_text("research_id,captured_at,status\nP1,t,complete\n ,t,partial\n")
    assert D.import_manifest(spark, str(tmp_path / "m.csv")).count() == 1
    roi = spark.createDataFrame([("P4", '{"summary":{"L":{"region_count":0,"has_risk_area":""}}}')], "stem string, value string")
    row = D.import_roi(roi)[0].first()
    assert row.research_id == "P4" and row.summary["L"].region_count == 0


@pytest.mark.parametrize("name,ok", [("/api/file/podo/P0001/preprocessing/P0001_podo_L_full.png", True), ("x<script>.png", False)])
def test_safe_file_names(spark, name, ok):
    docs = spark.createDataFrame([('{"_via_img_metadata": {"a": {"filename": "%s", "regions": []}}}' % name,)], "value string")
    good, bad = D.safe_filenames(docs)
    assert (good.count(), bad.count()) == ((1, 0) if ok else (0, 1))


def test_matrix_files(spark, tmp_path):
    (tmp_path / "S1_F_L.csv").write_text("30.5,0\n31,32.25\n")
    (tmp_path / "S1_F_R_LPA.csv").write_text("1,2\n3,4,5\n")  # a longer row than the first is unreadable
    (tmp_path / "S2_M_R_MCA.csv").write_text("x,2\n")
    rows = R.read_matrix_csv(spark, str(tmp_path)).orderBy("row_no", "col_no").collect()
    assert [(r.stem, r.zone, r.temp) for r in rows] == [("S1_F_L", "FullFoot", t) for t in (30.5, 0.0, 31.0, 32.25)]


@pytest.mark.parametrize("name,label", [("scan_image_tree", "tree"), ("read_matrix_csv", "matrix"), ("import_cases", "forms")])
def test_number_of_real_files_does_not_follow_the_documents(spark, name, label):
    root = Path(shared_dir(spark).removeprefix("file:"))
    before = set(root.glob(f"{label}-*"))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    (made,) = set(root.glob(f"{label}-*")) - before
    assert sum(p.suffix != ".crc" and p.name != "_SUCCESS" for p in made.rglob("*") if p.is_file()) <= 8 < spark.read.parquet(str(made)).count()


def test_packs_read_as_their_files(spark, tmp_path):
    files = {"DM/S1_F/L.png": "12", "DM/S1_F/notes.txt": "x", "CT/S2_M/R.png": "7", "P0001.json": '{"nurse": "a"}', "S1_F_L.csv": "30.5,0\n31,32.25\n", "S2_M_R_MCA.csv": "x,2\n"}
    for path, value in files.items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(value)
    K.write_pack(spark.createDataFrame([(f"/{p}", v) for p, v in files.items()], "path string, value string"), str(tmp_path / "pack"))
    tree, pack = str(tmp_path / "tree"), K.read_pack(spark, str(tmp_path / "pack"))
    same = lambda a, b: sorted(a.drop("path").collect(), key=str) == sorted(b.drop("path").collect(), key=str) != []
    assert same(I.scan_image_tree(spark, tree), I.image_tree(pack.select("path", F.octet_length("value").cast("bigint").alias("length"))))
    assert same(R.read_matrix_csv(spark, tree), R.matrix_cells(pack))
    assert same(D.read_documents(spark, tree), D.named_documents(pack))


def test_log_files(spark, tmp_path):
    (tmp_path / "run.txt").write_text("[2026-01-01 10:00:00] Epoch 5/50  val_loss=0.25\nplain text\n[2026-01-01 10:00:09]   Early stopping at epoch 7")
    rows = R.read_run_logs(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.kind, r.epoch, r.val_loss) for r in rows] == [("epoch", 5, 0.25), ("other", None, None), ("stop", 7, None)]
    assert rows[1].ts is None and rows[2].ts.second == 9


def _events(spark, tmp_path, files):
    path = str(tmp_path / "events")
    for rows in files:
        df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
        df.coalesce(1).write.mode("append").parquet(path)
    return S.event_stream(spark, path, files_per_trigger=1)


def _at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_state_over_several_batches_equals_batch(spark, tmp_path):
    files = [[(1, _at(1), 1, "signup", 5.0, "{}"), (2, _at(2), 2, "click", 4.0, "{}")], [(3, _at(3), 1, "view", 4.0, "{}"), (4, _at(4), 1, "purchase", 4.0, "{}")],
             [(5, _at(5), 1, "click", 4.0, "{}"), (6, _at(6), 2, "purchase", 3.0, "{}"), (7, _at(7), 1, "error", 9.0, "{}")]]
    for merge_every in (1, 2, 8):
        rows = {r.research_id: r for r in S.case_state(_events(spark, tmp_path / str(merge_every), files), merge_every=merge_every).collect()}
        assert rows["P0001"].status == "complete" and not rows["P0001"].has_form and rows["P0002"].status == "partial"


def test_state_is_compacted_and_batches_may_be_repeated(spark, tmp_path):
    path = str(tmp_path / "state")
    make = lambda n: spark.createDataFrame([(f"P{n % 3}", dt.datetime(2024, 1, 1, 0, n), n, "thermal" if n % 2 else "crf_save")], "research_id string, ts timestamp, event_id bigint, action string")
    for n in range(7):
        S.merge_batch(make(n), n, path, 3)
        S.merge_batch(make(n), n, path, 3)  # again, as after a failure
    assert S._pointer(spark, path)[:2] == (6, 5)
    before = sorted(S._layers(spark, path, S._pointer(spark, path), 3).collect())
    assert len(before) == 6 and len(spark.read.schema(S._STATE).parquet(f"{path}/base/{S._pointer(spark, path)[2]}").inputFiles()) >= 1
    make(7).withColumn("kind", F.lit("thermal")).write.mode("overwrite").parquet(f"{path}/delta/{7 % 3}")  # broke off before its pointer
    assert sorted(S._layers(spark, path, S._pointer(spark, path), 3).collect()) == before
    S.merge_batch(make(2), 2, path, 3)  # an old batch
    assert sorted(S._layers(spark, path, S._pointer(spark, path), 3).collect()) == before
    assert S.read_case_state(spark, str(tmp_path / "none")).count() == 0


def _losses(events):
    return events.select("research_id", "ts", "event_id", F.col("value").alias("loss"))


def test_early_stop_numbers_epochs_by_time(spark, tmp_path):
    losses = [5, 4, 4, 4, 4, 1, 1]
    rows = [(i, _at(i), 1, "view", float(v), "{}") for i, v in enumerate(losses)] + [(50, _at(60), 2, "view", 1.0, "{}")]
    order = [2, 0, 1, 4, 3, 6, 5, 7]
    stops = []
    for n, files in enumerate(([[r] for r in rows], [[rows[i]] for i in order], [[rows[i] for i in order]])):
        stream = _losses(_events(spark, tmp_path / str(n), files))
        stops.append([(r.research_id, r.stop_epoch, r.best_epoch, r.best_loss) for r in S.drain(S.early_stop_events(stream, 3, "5 minutes"), "append", "t").collect()])
    assert stops == [[("P0001", 5, 2, 4.0)]] * 3


def test_finished_runs_are_forgotten(spark, tmp_path):
    rows = [(i, _at(i), 1, "view", 1.0, "{}") for i in range(3)] + [(9, _at(300), 2, "view", 1.0, "{}")] + [(20 + i, _at(400 + i), 1, "view", 1.0, "{}") for i in range(3)] + [(30, _at(900), 2, "view", 1.0, "{}")]
    found = []
    for n, (forget, files) in enumerate((("1 hour", [[r] for r in rows]), ("1 hour", [rows]), ("365 days", [rows[:5], rows[5:]]))):
        stream = _losses(_events(spark, tmp_path / str(n), files))
        found.append(S.drain(S.early_stop_events(stream, 2, "1 minute", forget), "append", "t").where("research_id = 'P0001'").count())
    assert found == [2, 2, 1]


def test_captures_need_a_form_at_their_time(spark, tmp_path):
    rows = [(1, _at(1), 1, "view", 0.0, "{}"), (2, _at(2), 1, "signup", 0.0, "{}"), (3, _at(3), 1, "view", 0.0, "{}"), (4, _at(4), 1, "error", 0.0, "{}"), (5, _at(5), 1, "click", 0.0, "{}"),
            (6, _at(6), 1, "signup", 0.0, "{}"), (7, _at(6), 1, "click", 0.0, "{}"), (8, _at(3), 2, "click", 0.0, "{}"), (9, _at(99), 3, "view", 0.0, "{}")]
    want = {1: False, 3: True, 5: False, 7: True, 8: False}
    for n, files in enumerate(([rows], [[r] for r in rows], [[rows[i]] for i in (1, 0, 3, 2, 7, 4, 6, 5, 8)])):
        out = S.drain(S.capture_gate(_events(spark, tmp_path / str(n), files)), "append", "t")
        assert {r.event_id: r.accepted for r in out.collect()} == want and out.count() == len(want)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    files = [[(1, _at(0), 1, "view", 1.0, "{}")], [(2, _at(600), 1, "view", 1.0, "{}")], [(3, _at(601), 1, "view", 1.0, "{}")], [(4, _at(5), 1, "view", 1.0, "{}")]]
    out = S.drain(S.audit_counts(_events(spark, tmp_path, files)), "update", "late")
    assert out.groupBy().agg(F.sum(F.when(F.hour("window.start") == 0, F.col("n")))).first()[0] == 1


def test_csv_file_opens_with_mark_and_header(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{n:03}", 'a "b"' if n % 2 else None, n) for n in range(200)], "pid string, note string, n int").repartition(7)
    want = '\ufeffpid,note,n\n' + "".join('"p%03d",%s,"%d"\n' % (n, '"a ""b"""' if n % 2 else '""', n) for n in range(200))
    for name, df, text in (("all", rows, want), ("none", rows.where("false"), "\ufeffpid,note,n\n")):
        D.write_csv(df, ["pid", "note", "n"], ["pid"], str(tmp_path / name))
        assert b"".join(p.read_bytes() for p in sorted((tmp_path / name).glob("part-*"))).decode() == text
    assert D.read_csv_file(spark, str(tmp_path / "all")).orderBy("part", "line_no").first().value == "\ufeffpid,note,n"


@pytest.mark.parametrize("name", ["hottest_dev", "estimated_temp"])
def test_hottest_and_et_hold_one_row_per_zone(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    temps = spark.createDataFrame([(1, "A", t) for t in (0.0, 26.0, 28.6, 28.6, 30.0, 40.0)] + [(1, "B", 0.0), (2, "A", 33.0)], "image_id int, zone string, temp double")
    row = lambda df: sorted((r.image_id, r.zone, r.hottest, round(r.et, 9), round(r.hse, 9)) for r in df.collect())
    assert row(T.hottest_deviation(temps, ["image_id", "zone"])) == row(T.zone_features(temps, ["image_id", "zone"]))
