"""Run comparison: metrics per run and fold, ranking, thresholds and paired tests on the prediction view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from solea.operators import metrics as M
from solea.operators import paired_tests as P
from solea.plans.registry import EXTRA_CHECK_VIEWS, Inputs, query

RUN_FOLD = ["run_no", "fold"]
GRID = {"backbone": list(range(3)), "strategy": list(range(8)), "input": list(range(2))}

EXTRA_CHECK_VIEWS.update({
    "fold_auc": """SELECT run_no, fold, CASE WHEN min(y) = max(y) THEN NULL ELSE
        (sum(CASE WHEN y = 1 THEN rk END) - sum(y)*(sum(y)+1)/2.0) / (sum(y)*sum(1-y)) END AS auc
      FROM (SELECT *, rank() OVER (PARTITION BY run_no, fold ORDER BY p_a)
                      + (count(*) OVER (PARTITION BY run_no, fold, p_a) - 1)/2.0 AS rk FROM preds) GROUP BY run_no, fold""",
    "fold_counts": """SELECT run_no, fold, count(*) FILTER (p_a >= 0.5 AND y = 1) AS tp, count(*) FILTER (p_a < 0.5 AND y = 1) AS fn,
        count(*) FILTER (p_a < 0.5 AND y = 0) AS tn, count(*) FILTER (p_a >= 0.5 AND y = 0) AS fp FROM preds GROUP BY run_no, fold""",
    "fold_table": """SELECT c.*, a.auc, coalesce(tp/nullif(tp+fn,0),0) AS sens, coalesce(tn/nullif(tn+fp,0),0) AS spec,
        coalesce(tp/nullif(tp+fp,0),0) AS ppv, coalesce(tn/nullif(tn+fn,0),0) AS npv,
        coalesce(2*tp/nullif(2*tp+fp+fn,0),0) AS f1, coalesce((tp+tn)/nullif(tp+fn+tn+fp,0),0) AS acc
      FROM fold_counts c JOIN fold_auc a USING (run_no, fold)""",
    "run_table": """SELECT run_no, run_no % 3 AS backbone, run_no // 3 % 8 AS strategy, run_no // 24 AS input,
        avg(auc) AS auc_mean, stddev_pop(auc) AS auc_std, avg(sens) AS sens_mean, avg(spec) AS spec_mean, avg(f1) AS f1_mean
      FROM fold_table GROUP BY run_no""",
    "roc_points": """SELECT run_no, fold, p_a AS threshold, tp/max(tp) OVER w AS tpr, fp/max(fp) OVER w AS fpr FROM (
        SELECT run_no, fold, p_a, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp FROM (
          SELECT run_no, fold, p_a, sum(y) AS pos, sum(1-y) AS neg FROM preds GROUP BY run_no, fold, p_a)
        WINDOW o AS (PARTITION BY run_no, fold ORDER BY p_a DESC)) WINDOW w AS (PARTITION BY run_no, fold)
      UNION ALL SELECT DISTINCT run_no, fold, CAST('infinity' AS DOUBLE), 0.0, 0.0 FROM preds""",
    "youden": """SELECT run_no, fold, threshold, tpr AS sens, 1 - fpr AS spec FROM (
        SELECT *, row_number() OVER (PARTITION BY run_no, fold ORDER BY tpr - fpr DESC, threshold DESC) AS rn FROM roc_points) WHERE rn = 1""",
    "thr_compare": """SELECT run_no, max(mt) AS mean_thr, max(st) AS std_thr,
        avg(sd) AS sens_d_mean, stddev_pop(sd) AS sens_d_std, avg(pd) AS spec_d_mean, stddev_pop(pd) AS spec_d_std,
        avg(sy) AS sens_y_mean, stddev_pop(sy) AS sens_y_std, avg(py) AS spec_y_mean, stddev_pop(py) AS spec_y_std FROM (
        SELECT run_no, fold, max(mt) AS mt, max(st) AS st,
          coalesce(count(*) FILTER (y=1 AND p_a>=0.5)/nullif(sum(y),0),0) AS sd, coalesce(count(*) FILTER (y=0 AND p_a<0.5)/nullif(sum(1-y),0),0) AS pd,
          coalesce(count(*) FILTER (y=1 AND p_a>=mt)/nullif(sum(y),0),0) AS sy, coalesce(count(*) FILTER (y=0 AND p_a<mt)/nullif(sum(1-y),0),0) AS py
        FROM preds JOIN (SELECT run_no, round(avg(threshold), 12) AS mt, stddev_pop(threshold) AS st FROM youden GROUP BY run_no) USING (run_no)
        GROUP BY run_no, fold) GROUP BY run_no""",
})


def model_a(t: Inputs):
    return t.preds.select("sample_id", "run_no", "fold", "y", F.col("p_a").alias("p"))


def paired(t: Inputs):
    return P.pair_predictions(model_a(t), t.preds.select("sample_id", F.col("p_b").alias("p")))


def summary(t: Inputs):
    runs = M.run_summary(M.fold_metrics(t.preds, RUN_FOLD, "p_a"), ["run_no"])
    return runs.withColumns({"backbone": F.col("run_no") % 3, "strategy": F.floor(F.col("run_no") / 3) % 8, "input": F.floor(F.col("run_no") / 24)})


@query("preds_long", "run_no:i fold:i sample_id:i y:i p:f", "SELECT run_no, fold, sample_id, y, p_a AS p FROM preds")
def _(t):
    """Folds are keyed per order here, so each stored array holds the few samples of one (run, fold, order)."""
    keyed = t.preds.withColumn("pos", F.col("sample_id") % 10)
    arrays = keyed.groupBy("run_no", "fold", "group_id").agg(F.sort_array(F.collect_list(F.struct("pos", "p_a"))).alias("cells"))
    long = arrays.select("run_no", "fold", "group_id", F.posexplode("cells").alias("at", "cell"))
    long = long.select("run_no", "fold", F.struct("group_id", "at").alias("pos"), F.col("cell.p_a").alias("p"))
    stored = long.groupBy("run_no", "fold", F.col("pos.group_id").alias("group_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("pos.at").alias("at"), "p"))).alias("c")
    ).select("run_no", F.concat_ws("/", "fold", "group_id").alias("fold"), F.transform("c", lambda c: c["p"]).alias("p"))
    order = Window.partitionBy("run_no", "fold", "group_id").orderBy("sample_id")
    labels = t.preds.select(
        "run_no", F.concat_ws("/", "fold", "group_id").alias("fold"), (F.row_number().over(order) - 1).alias("pos"),
        "sample_id", "y",
    )
    return M.preds_from_folds(stored, labels).withColumn("fold", F.split("fold", "/")[0].cast("bigint"))


@query("binarise_scores", "sample_id:i pred:i", "SELECT sample_id, CASE WHEN p_a >= 0.5 THEN 1 ELSE 0 END AS pred FROM preds")
def _(t):
    return M.binarise(t.preds, "p_a")


@query("confusion_counts", "run_no:i fold:i tp:i fn:i tn:i fp:i", "SELECT * FROM fold_counts")
def _(t):
    return M.confusion_counts(t.preds, RUN_FOLD, "p_a")


@query("binary_metrics", "run_no:i fold:i sens:f spec:f ppv:f npv:f f1:f acc:f", "SELECT * FROM fold_table")
def _(t):
    return M.binary_metrics(M.confusion_counts(t.preds, RUN_FOLD, "p_a"))


@query("auc_rank", "run_no:i fold:i auc:f", "SELECT * FROM fold_auc")
def _(t):
    return M.auc(t.preds, RUN_FOLD, "p_a")


@query("fold_summary", "run_no:i metric:s mean:f std:f",
       " UNION ALL ".join(f"SELECT run_no, '{m}' AS metric, avg({m}) AS mean, stddev_pop({m}) AS std FROM fold_table GROUP BY run_no" for m in M.METRICS))
def _(t):
    return M.fold_summary(M.fold_metrics(t.preds, RUN_FOLD, "p_a"), ["run_no"])


@query("rank_runs", "input:i rank:i run_no:i auc_mean:f auc_std:f sens_mean:f spec_mean:f f1_mean:f best:b",
       """SELECT *, rank = 1 AS best FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY auc_mean DESC, run_no) AS rank FROM run_table)""")
def _(t):
    return M.rank_runs(summary(t), "input", "run_no")


@query("best_run_overall", "run_no:i input:i auc_mean:f", "SELECT run_no, input, auc_mean FROM run_table ORDER BY auc_mean DESC, input, run_no LIMIT 1")
def _(t):
    return M.best_run_overall(summary(t), "input", "run_no")


@query("best_pair_strategy", "backbone:i strategy:i pair_auc:f",
       """SELECT backbone, strategy, avg(auc_mean) AS pair_auc FROM run_table WHERE backbone = (
            SELECT backbone FROM run_table WHERE input = 1 ORDER BY auc_mean DESC, run_no LIMIT 1)
          GROUP BY backbone, strategy HAVING count(*) = 2 ORDER BY pair_auc DESC, strategy LIMIT 1""")
def _(t):
    return M.best_pair_strategy(summary(t))


@query("best_fold", "run_no:i fold:i auc:f",
       """SELECT run_no, fold, auc FROM (SELECT *, row_number() OVER (PARTITION BY run_no ORDER BY auc DESC NULLS LAST, fold) AS rn FROM fold_auc)
          WHERE rn = 1""")
def _(t):
    return M.best_fold(M.auc(t.preds, RUN_FOLD, "p_a"), ["run_no"])


@query("run_progress", "input:i completed:i expected:i",
       "SELECT input, count(DISTINCT run_no) AS completed, 24 AS expected FROM run_table WHERE run_no % 7 <> 0 GROUP BY input")
def _(t):
    done = t.preds.filter("run_no % 7 <> 0").select("run_no", F.floor(F.col("run_no") / 24).alias("input"))
    return M.run_progress(done, "input", "run_no", 24)


def _found(t):
    done = t.preds.select("run_no").distinct().filter("run_no % 7 <> 0")
    return done.select((F.col("run_no") % 3).alias("backbone"), (F.floor(F.col("run_no") / 3) % 8).alias("strategy"), F.floor(F.col("run_no") / 24).alias("input"))


@query("missing_runs", "backbone:i strategy:i input:i",
       """SELECT b AS backbone, s AS strategy, i AS input FROM (SELECT unnest(range(3)) AS b), (SELECT unnest(range(8)) AS s), (SELECT unnest(range(2)) AS i)
          EXCEPT SELECT run_no % 3, run_no // 3 % 8, run_no // 24 FROM preds WHERE run_no % 7 <> 0""")
def _(t):
    return M.missing_runs(_found(t), GRID)


@query("resume_runs", "run_no:i fold:i",
       "SELECT DISTINCT run_no, fold FROM preds WHERE run_no NOT IN (SELECT run_no FROM preds WHERE run_no % 7 <> 0)")
def _(t):
    wanted = t.preds.select("run_no", "fold").distinct()
    return M.resume_runs(wanted, t.preds.filter("run_no % 7 <> 0").select("run_no").distinct(), ["run_no"])


@query("criteria_gate", "backbone:i auc_mean:f sens_mean:f spec_mean:f qualifies:b any_pass:b chosen:b",
       """WITH b AS (SELECT backbone, avg(auc) AS auc_mean, avg(sens) AS sens_mean, avg(spec) AS spec_mean FROM (
            SELECT run_no % 3 AS backbone, fold, auc, sens, spec FROM fold_table) GROUP BY backbone),
          q AS (SELECT *, auc_mean >= 0.45 AND sens_mean >= 0.49 AND spec_mean >= 0.40 AS qualifies FROM b)
          SELECT *, bool_or(qualifies) OVER () AS any_pass, row_number() OVER (ORDER BY qualifies DESC, auc_mean DESC, backbone) = 1 AS chosen FROM q""")
def _(t):
    per = M.fold_metrics(t.preds, RUN_FOLD, "p_a").withColumn("backbone", F.col("run_no") % 3)
    return M.criteria_gate(M.run_summary(per, ["backbone"]), "backbone", {"auc": 0.45, "sens": 0.49, "spec": 0.40})


@query("class_report", "run_no:i label:s precision:f recall:f f1:f support:i",
       """WITH c AS (SELECT run_no, sum(tp) AS tp, sum(fn) AS fn, sum(tn) AS tn, sum(fp) AS fp FROM fold_counts GROUP BY run_no),
          k AS (SELECT run_no, '0' AS label, tn AS hit, tn+fn AS said, tn+fp AS support FROM c
                UNION ALL SELECT run_no, '1', tp, tp+fp, tp+fn FROM c),
          r AS (SELECT run_no, label, coalesce(hit/nullif(said,0),0) AS precision, coalesce(hit/nullif(support,0),0) AS recall,
                       coalesce(2*hit/nullif(said+support,0),0) AS f1, support, hit FROM k)
          SELECT run_no, label, precision, recall, f1, support FROM r
          UNION ALL SELECT run_no, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r GROUP BY run_no
          UNION ALL SELECT run_no, 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support), sum(support) FROM r GROUP BY run_no
          UNION ALL SELECT run_no, 'accuracy', NULL, NULL, sum(hit)/sum(support), sum(support) FROM r GROUP BY run_no""")
def _(t):
    return M.class_report(t.preds, ["run_no"], "p_a")


@query("class_weights", "run_no:i y:i count:i weight:f",
       """SELECT run_no, y, count(*) AS count, sum(count(*)) OVER (PARTITION BY run_no) / (count(*) OVER (PARTITION BY run_no) * count(*)) AS weight
          FROM preds GROUP BY run_no, y""")
def _(t):
    return M.class_weights(t.preds, ["run_no"])


@query("backfill_metric", "run_no:i npv_mean:f npv_std:f updated:b",
       "SELECT run_no, avg(npv) AS npv_mean, stddev_pop(npv) AS npv_std, run_no % 3 = 0 AS updated FROM fold_table GROUP BY run_no")
def _(t):
    full = M.binary_metrics(M.confusion_counts(t.preds, RUN_FOLD, "p_a"))
    stored = full.withColumn("npv", F.when(F.col("run_no") % 3 != 0, F.col("npv")))
    return M.backfill_metric(stored, t.preds, "run_no", "fold", "npv", "p_a")


@query("roc_curve", "run_no:i fold:i threshold:f tpr:f fpr:f", "SELECT * FROM roc_points")
def _(t):
    return M.roc_curve(t.preds, RUN_FOLD, "p_a")


@query("youden_threshold", "run_no:i fold:i threshold:f sens:f spec:f", "SELECT * FROM youden")
def _(t):
    return M.youden_threshold(t.preds, RUN_FOLD, "p_a")


_THR = "run_no:i mean_thr:f std_thr:f sens_d_mean:f sens_d_std:f spec_d_mean:f spec_d_std:f sens_y_mean:f sens_y_std:f spec_y_mean:f spec_y_std:f"


@query("mean_threshold_compare", _THR, "SELECT * FROM thr_compare")
def _(t):
    return M.mean_threshold_compare(t.preds, "run_no", "fold", "p_a")


@query("metric_deltas", "run_no:i sens_delta:f sens_pct:f spec_delta:f spec_pct:f",
       """SELECT run_no, sens_y_mean - sens_d_mean AS sens_delta,
            CASE WHEN sens_d_mean > 1e-9 THEN (sens_y_mean - sens_d_mean)/sens_d_mean*100 ELSE 0 END AS sens_pct,
            spec_y_mean - spec_d_mean AS spec_delta,
            CASE WHEN spec_d_mean > 1e-9 THEN (spec_y_mean - spec_d_mean)/spec_d_mean*100 ELSE 0 END AS spec_pct FROM thr_compare""")
def _(t):
    both = M.metric_deltas(M.mean_threshold_compare(t.preds, "run_no", "fold", "p_a"), "sens_d_mean", "sens_y_mean", "sens")
    return M.metric_deltas(both, "spec_d_mean", "spec_y_mean", "spec")


@query("threshold_sweep", "run_no:i threshold:f sens:f spec:f meets_floor:b",
       """WITH r AS (SELECT run_no, i, coalesce(count(*) FILTER (y=1 AND p_b >= i*5/100.0)/nullif(sum(y),0),0) AS sens,
              coalesce(count(*) FILTER (y=0 AND NOT p_b >= i*5/100.0)/nullif(sum(1-y),0),0) AS spec
            FROM preds, (SELECT unnest(range(1,20)) AS i) GROUP BY run_no, i),
          q AS (SELECT *, sens >= 0.7 AND spec >= 0.7 AS ok FROM r)
          SELECT run_no, i*5/100.0 AS threshold, sens, spec, ok AS meets_floor FROM (SELECT *, row_number() OVER (PARTITION BY run_no
            ORDER BY ok DESC, CASE WHEN ok THEN sens ELSE sens + spec - 1 END DESC, i) AS rn FROM q) WHERE rn = 1""")
def _(t):
    return M.threshold_sweep(t.preds, ["run_no"], "p_b")


@query("confident_examples", "run_no:i sample_id:i y:i p_b:f rn:i",
       """SELECT run_no, sample_id, y, p_b, rn FROM (SELECT *, row_number() OVER (PARTITION BY run_no, y ORDER BY CASE WHEN y = 1 THEN -p_b ELSE p_b END, sample_id) AS rn
            FROM preds WHERE (y = 1 AND p_b >= 0.7) OR (y = 0 AND p_b <= 0.3)) WHERE rn <= 4""")
def _(t):
    return M.confident_examples(t.preds, ["run_no"], "p_b")


@query("best_combination", "ranking:i classifier:i n_features:i mean_auc4:f",
       """SELECT input AS ranking, strategy AS classifier, backbone AS n_features, round_even(auc_mean, 4) AS mean_auc4 FROM run_table
          ORDER BY round_even(auc_mean, 4) DESC, input, strategy, backbone LIMIT 1""")
def _(t):
    results = summary(t).select(F.col("input").alias("ranking"), F.col("strategy").alias("classifier"), F.col("backbone").alias("n_features"), F.col("auc_mean").alias("mean_auc"))
    return M.best_combination(results, ["ranking", "classifier", "n_features"])


@query("paired_predictions", "sample_id:i y:i p_a:f p_b:f", "SELECT sample_id, y, p_a, p_b FROM preds")
def _(t):
    return paired(t)


@query("discordant_cases", "run_no:i sample_id:i tag:s p_a4:f p_b4:f",
       """SELECT run_no, sample_id, CASE WHEN p_a >= 0.5 THEN 'b' ELSE 'c' END AS tag, round_even(p_a,4) AS p_a4, round_even(p_b,4) AS p_b4
          FROM preds WHERE y = 1 AND (p_a >= 0.5) <> (p_b >= 0.5)""")
def _(t):
    return P.discordant_cases(paired(t))


def _mcnemar_sql(rows: str, by: str) -> str:
    return f"""WITH m AS (SELECT {by}, count(*) FILTER (((p_a>=0.5)=(y=1)) AND ((p_b>=0.5)<>(y=1))) AS b,
            count(*) FILTER (((p_a>=0.5)<>(y=1)) AND ((p_b>=0.5)=(y=1))) AS c, count(*) AS n_samples FROM {rows} GROUP BY {by}),
          s AS (SELECT *, b+c AS n, sqrt((abs(b-c)-1)*(abs(b-c)-1)/nullif(b+c,0)/2.0) AS z FROM m)
          SELECT *, CASE WHEN n = 0 THEN 1.0 WHEN n < 25 THEN least(1.0, 2*list_sum(list_transform(range(0, least(b,c)+1),
              lambda i: exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)-n*ln(2)))))
            ELSE 1 - CASE WHEN z >= 6 THEN 1.0 WHEN z = 0 THEN 0.0 ELSE 2/sqrt(pi())*exp(-z*z)*list_sum(list_transform(range(0,141),
              lambda k: exp(k*ln(2)+(2*k+1)*ln(z)-(lgamma(2*k+2)-k*ln(2)-lgamma(k+1))))) END END AS p_value FROM s"""


@query("mcnemar_all", "run_no:i b:i c:i n_samples:i p_value:f", _mcnemar_sql("preds", "run_no"))
def _(t):
    return P.mcnemar(t.preds, ["run_no"])


@query("mcnemar_positives", "run_no:i fold:i b:i c:i n_samples:i p_value:f", _mcnemar_sql("(SELECT * FROM preds WHERE y = 1)", "run_no, fold"))
def _(t):
    return P.mcnemar(t.preds, RUN_FOLD, positives_only=True)


@query("significance_stars", "run_no:i stars:s",
       "SELECT run_no, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM (SELECT run_no, p_value AS p FROM ("
       + _mcnemar_sql("preds", "run_no") + "))")
def _(t):
    return P.mcnemar(t.preds, ["run_no"]).withColumn("stars", P.significance_stars(F.col("p_value")))


@query("delong_test", "run_no:i auc_a:f auc_b:f delta:f z:f p_value:f",
       """WITH r AS (SELECT *,
              (rank() OVER (PARTITION BY run_no ORDER BY p_a) + (count(*) OVER (PARTITION BY run_no, p_a)-1)/2.0)
            - (rank() OVER (PARTITION BY run_no, y ORDER BY p_a) + (count(*) OVER (PARTITION BY run_no, y, p_a)-1)/2.0) AS oa,
              (rank() OVER (PARTITION BY run_no ORDER BY p_b) + (count(*) OVER (PARTITION BY run_no, p_b)-1)/2.0)
            - (rank() OVER (PARTITION BY run_no, y ORDER BY p_b) + (count(*) OVER (PARTITION BY run_no, y, p_b)-1)/2.0) AS ob,
              sum(y) OVER (PARTITION BY run_no) AS p, sum(1-y) OVER (PARTITION BY run_no) AS n FROM preds),
          v AS (SELECT run_no, y, CASE WHEN y=1 THEN oa/n ELSE 1-oa/p END AS a, CASE WHEN y=1 THEN ob/n ELSE 1-ob/p END AS b FROM r),
          c AS (SELECT run_no, y, avg(a) AS ma, avg(b) AS mb, (var_samp(a)+var_samp(b)-2*covar_samp(a,b))/count(*) AS part FROM v GROUP BY run_no, y),
          d AS (SELECT run_no, max(CASE WHEN y=1 THEN ma END) AS auc_a, max(CASE WHEN y=1 THEN mb END) AS auc_b, sum(part) AS vd FROM c GROUP BY run_no),
          z AS (SELECT *, auc_a-auc_b AS delta, (auc_a-auc_b)/sqrt(vd) AS z, abs(auc_a-auc_b)/sqrt(vd)/sqrt(2) AS x FROM d)
          SELECT *, 1 - CASE WHEN x >= 6 THEN 1.0 ELSE 2/sqrt(pi())*exp(-x*x)*list_sum(list_transform(range(0,141),
              lambda k: exp(k*ln(2)+(2*k+1)*ln(x)-(lgamma(2*k+2)-k*ln(2)-lgamma(k+1))))) END AS p_value FROM z""")
def _(t):
    return P.delong(t.preds, ["run_no"])


@query("bootstrap_ci", "run_no:i metric:s lo:f hi:f n_valid:i")
def _(t):
    return P.bootstrap_ci(t.preds, ["run_no"], "p_b")


_REPORT_SQL = """WITH m AS (SELECT run_no, 'a' AS model, p_a AS p, y FROM preds UNION ALL SELECT run_no, 'b', p_b, y FROM preds),
  k AS (SELECT run_no, model, count(*) FILTER (p>=0.5 AND y=1) AS tp, count(*) FILTER (p<0.5 AND y=1) AS fn, count(*) FILTER (p<0.5 AND y=0) AS tn,
        count(*) FILTER (p>=0.5 AND y=0) AS fp FROM m GROUP BY run_no, model),
  r AS (SELECT *, rank() OVER (PARTITION BY run_no, model ORDER BY p) + (count(*) OVER (PARTITION BY run_no, model, p)-1)/2.0 AS rk FROM m),
  u AS (SELECT run_no, model, (sum(CASE WHEN y=1 THEN rk END)-sum(y)*(sum(y)+1)/2.0)/(sum(y)*sum(1-y)) AS auc FROM r GROUP BY run_no, model),
  w AS (SELECT run_no, model, unnest(['sens','spec','ppv','npv','f1','auc']) AS metric, unnest([coalesce(tp/nullif(tp+fn,0),0), coalesce(tn/nullif(tn+fp,0),0),
        coalesce(tp/nullif(tp+fp,0),0), coalesce(tn/nullif(tn+fn,0),0), coalesce(2*tp/nullif(2*tp+fp+fn,0),0), auc]) AS value FROM k JOIN u USING (run_no, model))
  SELECT run_no, metric, max(CASE WHEN model='a' THEN value END) AS value_a, max(CASE WHEN model='b' THEN value END) AS value_b,
    max(CASE WHEN model='a' THEN value END) - max(CASE WHEN model='b' THEN value END) AS delta, true AS within_a, true AS within_b FROM w GROUP BY run_no, metric"""


@query("model_comparison_report", "run_no:i metric:s value_a:f value_b:f delta:f within_a:b within_b:b", _REPORT_SQL)
def _(t):
    """With bootstrap limits; as they are random, what is compared is that they enclose the value (to their four places)."""
    by = ["run_no"]
    limits = [P.bootstrap_ci(t.preds, by, score) for score in ("p_a", "p_b")]
    report = P.comparison_report(M.fold_metrics(t.preds, by, "p_a"), M.fold_metrics(t.preds, by, "p_b"), by, *limits)
    inside = lambda m: F.coalesce(F.col(f"value_{m}").between(F.col(f"lo_{m}") - 1e-4, F.col(f"hi_{m}") + 1e-4), F.lit(True)).alias(f"within_{m}")
    return report.select("*", inside("a"), inside("b"))
