"""Verification queries over the ``scored`` predictions (A7-A14, A18-A24,
A31, P24-P25, W11-W14, T1, T3, T4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gale.functions.names import CLASS_LABELS_2
from gale.operators import clean, verify
from gale.plans import views as V
from gale.plans.catalog import R, register
from gale.session import checkpoint_dir, materialize

G = ["Model", "BASIN", "Fold"]
GS = "Model, BASIN, Fold"


def _scored(spark, sf_dir):
    return V.scored(spark, sf_dir).select("Model", "BASIN", "Fold", "y_true", "y_pred", "p1")


# every statistic is given per basin and for the 'ALL' scope
_SCOPE = """sc AS (SELECT Model, BASIN, Fold, y_true, y_pred, p1 FROM scored
           UNION ALL SELECT Model, 'ALL' AS BASIN, Fold, y_true, y_pred, p1 FROM scored)"""


def _counts(spark, sf_dir):
    """(group, distinct score) counts: every curve reads them several times,
    so they are materialized once (a table in the shared folder) instead
    of re-aggregating the prediction rows in each branch of the plan."""
    checkpoint_dir(spark)
    return verify.score_counts(_scored(spark, sf_dir), G, "y_true", "p1", basin_col="BASIN").transform(materialize)


def _cum(spark, sf_dir):
    """Cumulative hits per distinct score, materialized: the PR curve, the
    ROC curve and the areas all read it."""
    return materialize(verify.cumulative_table(_counts(spark, sf_dir), G))


def _pr(spark, sf_dir, cum=None):
    return verify.precision_recall_curve(None, G, cum=cum if cum is not None else _cum(spark, sf_dir))


_CM_SQL = f"""
{_SCOPE},
c AS (SELECT {GS}, y_true, y_pred, count(*) AS n FROM sc GROUP BY ALL),
k AS (SELECT unnest([0, 1]) AS Category),
a AS (SELECT {GS}, Category,
        CAST(sum(CASE WHEN y_pred = Category THEN n ELSE 0 END) AS BIGINT) AS N_predicted,
        CAST(sum(CASE WHEN y_true = Category THEN n ELSE 0 END) AS BIGINT) AS N_actual,
        CAST(sum(CASE WHEN y_true = Category AND y_pred = Category THEN n ELSE 0 END) AS BIGINT) AS Hits,
        CAST(sum(n) AS BIGINT) AS tot
      FROM c CROSS JOIN k GROUP BY ALL),
cm AS (SELECT {GS}, Category, CASE Category WHEN 1 THEN 'RI' ELSE 'no RI' END AS Category_Name,
        N_predicted, N_actual, Hits, N_predicted - Hits AS False_Alarms, N_actual - Hits AS Misses,
        tot - N_predicted - N_actual + Hits AS Correct_Negs FROM a),
cms AS (SELECT *, Hits / nullif(Hits + Misses, 0) AS POD, False_Alarms / nullif(False_Alarms + Hits, 0) AS FAR,
        False_Alarms / nullif(False_Alarms + Correct_Negs, 0) AS PFOD, Hits / nullif(Hits + False_Alarms, 0) AS SR,
        Hits / nullif(Hits + Misses + False_Alarms, 0) AS Threat,
        (Hits + False_Alarms) / nullif(Hits + Misses, 0) AS BIAS FROM cm)
"""
_CM_OUT = ("Model, BASIN, Fold, Category, Category_Name, N_predicted, N_actual, Hits, False_Alarms, Misses, "
           f"Correct_Negs, {R('POD')} AS POD, {R('FAR')} AS FAR, {R('PFOD')} AS PFOD, {R('SR')} AS SR, "
           f"{R('Threat')} AS Threat, {R('BIAS')} AS BIAS")


def _class_counts(spark, sf_dir):
    """(model, basin/ALL, fold, y, y_hat) -> n, materialized once: the
    contingency and report tables read it from several plan branches."""
    checkpoint_dir(spark)
    return verify.class_counts(_scored(spark, sf_dir), G, "y_true", "y_pred", basin_col="BASIN").transform(materialize)


def _cm(spark, sf_dir):
    return verify.contingency_from_counts(_class_counts(spark, sf_dir), G, "y_true", "y_pred", [0, 1],
                                          CLASS_LABELS_2)


@register("contingency_stats", f"WITH {_CM_SQL} SELECT {_CM_OUT} FROM cms", ("scored",))
def q_contingency_stats(spark, sf_dir):
    """A7 + A31: one-vs-rest contingency scores per class, basin and ALL."""
    return _cm(spark, sf_dir)


@register("evaluate_scopes", f"""
WITH {_SCOPE}
SELECT Model, BASIN, count(*) AS n_cases, CAST(sum(y_true) AS BIGINT) AS n_events FROM sc GROUP BY ALL
""", ("scored",))
def q_evaluate_scopes(spark, sf_dir):
    """Row and event counts per basin plus the ALL scope, built from the
    per-basin aggregate (the big table is not duplicated)."""
    s = _scored(spark, sf_dir)
    c = s.groupBy("Model", "BASIN").agg(F.count(F.lit(1)).alias("n_cases"),
                                        F.sum("y_true").cast("bigint").alias("n_events"))
    return verify.with_all_scope(c, "BASIN", ["n_cases", "n_events"], ["Model"])


@register("classification_report", f"""
WITH {_SCOPE},
c AS (SELECT {GS}, y_true, y_pred, count(*) AS n FROM sc GROUP BY ALL),
l AS (SELECT DISTINCT {GS}, y_true AS c FROM c UNION SELECT DISTINCT {GS}, y_pred FROM c),
p AS (SELECT c.Model, c.BASIN, c.Fold, l.c,
        sum(CASE WHEN y_pred = l.c THEN n ELSE 0 END) AS np, sum(CASE WHEN y_true = l.c THEN n ELSE 0 END) AS na,
        sum(CASE WHEN y_true = l.c AND y_pred = l.c THEN n ELSE 0 END) AS tp, sum(n) AS tot
      FROM c JOIN l ON c.Model = l.Model AND c.BASIN = l.BASIN AND c.Fold = l.Fold GROUP BY ALL),
q AS (SELECT *, coalesce(tp / nullif(np, 0), 0) AS pr, coalesce(tp / nullif(na, 0), 0) AS rc FROM p),
f AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM q),
g AS (SELECT {GS}, sum(tp) AS tp, max(tot) AS tot, avg(pr) AS mp, avg(rc) AS mr, avg(f1) AS mf,
        sum(pr * na) AS wp, sum(rc * na) AS wr, sum(f1 * na) AS wf FROM f GROUP BY ALL),
u AS (SELECT {GS}, CAST(c AS VARCHAR) AS label, pr AS precision, rc AS recall, f1 AS f1_score, CAST(na AS DOUBLE) AS support FROM f
      UNION ALL SELECT {GS}, 'accuracy', coalesce(tp / nullif(tot, 0), 0), coalesce(tp / nullif(tot, 0), 0), coalesce(tp / nullif(tot, 0), 0), CAST(tot AS DOUBLE) FROM g
      UNION ALL SELECT {GS}, 'macro avg', mp, mr, mf, CAST(tot AS DOUBLE) FROM g
      UNION ALL SELECT {GS}, 'weighted avg', coalesce(wp / nullif(tot, 0), 0), coalesce(wr / nullif(tot, 0), 0), coalesce(wf / nullif(tot, 0), 0), CAST(tot AS DOUBLE) FROM g)
SELECT {GS}, label, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1_score')} AS f1_score, {R('support')} AS support FROM u
""", ("scored",))
def q_classification_report(spark, sf_dir):
    """precision/recall/f1/support per class with accuracy, macro and weighted rows."""
    return verify.report_from_counts(_class_counts(spark, sf_dir), G, "y_true", "y_pred")


@register("brier_reference", f"""
WITH {_SCOPE}, t AS (SELECT k / 10.0 AS Threshold FROM range(0, 11) r(k))
SELECT {GS}, {R('Threshold')} AS Threshold, {R('avg(power(y_true - Threshold, 2))')} AS BS, {R('avg(y_true)')} AS BS_ref,
       {R('avg(power(p1 - y_true, 2))')} AS BS_model,
       {R('1 - avg(power(p1 - y_true, 2)) / nullif(avg(y_true), 0)')} AS BSS_model
FROM sc CROSS JOIN t GROUP BY ALL
""", ("scored",))
def q_brier_reference(spark, sf_dir):
    """Brier score of constant forecasts 0..1 by 0.1, BS_ref, model Brier and skill."""
    return verify.brier_table(_scored(spark, sf_dir), G, "y_true", "p1", basin_col="BASIN")


_CUM_SQL = f"""
{_SCOPE},
c AS (SELECT {GS}, p1 AS score, sum(y_true) AS tp_c, sum(1 - y_true) AS fp_c FROM sc GROUP BY ALL),
cum AS (SELECT *, sum(tp_c) OVER w AS TP, sum(fp_c) OVER w AS FP, sum(tp_c) OVER g AS P, sum(fp_c) OVER g AS N,
          row_number() OVER w AS pos, count(*) OVER g AS ns,
          lead(tp_c) OVER w AS tpn, lead(fp_c) OVER w AS fpn
        FROM c WINDOW w AS (PARTITION BY {GS} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      g AS (PARTITION BY {GS})),
pr0 AS (SELECT {GS}, score AS Thresholds, TP / (TP + FP) AS Precision, TP / nullif(P, 0) AS Recall FROM cum),
pr AS (SELECT *, 2 * Precision * Recall / nullif(Precision + Recall, 0) AS F1 FROM pr0)
"""


@register("precision_recall_curve", f"""
WITH {_CUM_SQL}
SELECT {GS}, {R('Thresholds')} AS Thresholds, {R('Precision')} AS Precision, {R('Recall')} AS Recall, {R('F1')} AS F1 FROM pr
""", ("scored",))
def q_precision_recall_curve(spark, sf_dir):
    """A10 + W12: precision/recall/F1 per distinct score via distributed cumulative hits."""
    return _pr(spark, sf_dir).select(*G, "Thresholds", "Precision", "Recall", "F1")


@register("cumulative_hits", f"""
WITH {_CUM_SQL}
SELECT {GS}, {R('score')} AS score, CAST(TP AS BIGINT) AS TP, CAST(FP AS BIGINT) AS FP FROM cum
""", ("scored",))
def q_cumulative_hits(spark, sf_dir):
    """Events / non-events at or above each distinct score (two-level scan)."""
    c = _cum(spark, sf_dir)
    return c.select(*G, "score", F.col("TP").cast("bigint").alias("TP"), F.col("FP").cast("bigint").alias("FP"))


@register("choose_cutoff", f"""
WITH {_CUM_SQL}, m AS (SELECT {GS}, max(F1) AS mf FROM pr GROUP BY ALL)
SELECT pr.Model, pr.BASIN, pr.Fold, {R('min(Thresholds)')} AS Cutoff_Threshold FROM pr
JOIN m ON pr.Model = m.Model AND pr.BASIN = m.BASIN AND pr.Fold = m.Fold WHERE pr.F1 = m.mf GROUP BY ALL
""", ("scored",))
def q_choose_cutoff(spark, sf_dir):
    """Lowest threshold of maximal F1 (the f1_weighted rule)."""
    return verify.choose_cutoff(_pr(spark, sf_dir), G, "f1_weighted")


@register("choose_cutoff_recall", f"""
WITH {_CUM_SQL}
SELECT {GS}, {R('min(CASE WHEN Precision > Recall THEN Thresholds END)')} AS Cutoff_Threshold FROM pr GROUP BY ALL
""", ("scored",))
def q_choose_cutoff_recall(spark, sf_dir):
    """recall_weighted/'equal' rule: lowest threshold where P > R."""
    return verify.choose_cutoff(_pr(spark, sf_dir), G, "recall_weighted", "equal")


@register("roc_curve_auc", f"""
WITH {_CUM_SQL},
auc AS (SELECT {GS}, sum((FP / nullif(N, 0) - (FP - fp_c) / nullif(N, 0)) * (TP / nullif(P, 0) + (TP - tp_c) / nullif(P, 0)) / 2) AS AUC
        FROM cum GROUP BY ALL),
pts AS (SELECT {GS}, FP / nullif(N, 0) AS FPR, TP / nullif(P, 0) AS TPR, score AS Threshold FROM cum
        WHERE pos = 1 OR pos = ns OR NOT (tpn = tp_c AND fpn = fp_c)
        UNION ALL SELECT {GS}, 0.0, 0.0, score + 1 FROM cum WHERE pos = 1)
SELECT pts.Model, pts.BASIN, pts.Fold, {R('FPR')} AS FPR, {R('TPR')} AS TPR, {R('Threshold')} AS Threshold, {R('AUC')} AS AUC
FROM pts JOIN auc ON pts.Model = auc.Model AND pts.BASIN = auc.BASIN AND pts.Fold = auc.Fold
""", ("scored",))
def q_roc_curve_auc(spark, sf_dir):
    """A12 + W13: ROC points (scikit-learn's intermediate-point rule) and trapezoid AUC."""
    return verify.roc_curve(None, G, cum=_cum(spark, sf_dir))


@register("choose_cutoff_precision", f"""
WITH {_CUM_SQL}
SELECT {GS}, {R('min(CASE WHEN Recall > Precision THEN Thresholds END)')} AS Cutoff_Threshold FROM pr GROUP BY ALL
""", ("scored",))
def q_choose_cutoff_precision(spark, sf_dir):
    """precision_weighted/'equal' rule: lowest threshold where R > P."""
    return verify.choose_cutoff(_pr(spark, sf_dir), G, "precision_weighted", "equal")


@register("choose_cutoff_numeric", f"""
WITH {_CUM_SQL}
SELECT 'recall' AS rule, {GS}, {R('min(CASE WHEN round_even(Recall * 10, 0) / 10 < 1 - 0.2 THEN Thresholds END)')} AS Cutoff_Threshold FROM pr GROUP BY ALL
UNION ALL
SELECT 'precision', {GS}, {R('min(CASE WHEN round_even(Precision * 10, 0) / 10 < 1 - 0.2 THEN Thresholds END)')} FROM pr GROUP BY ALL
""", ("scored",))
def q_choose_cutoff_numeric(spark, sf_dir):
    """Numeric cut of 0.2: lowest threshold whose recall (precision), rounded to 0.1, is below 0.8."""
    pr = materialize(_pr(spark, sf_dir))
    return verify.choose_cutoff(pr, G, "recall_weighted", 0.2).withColumn("rule", F.lit("recall")).unionByName(
        verify.choose_cutoff(pr, G, "precision_weighted", 0.2).withColumn("rule", F.lit("precision")))


@register("scores_at_cutoff", f"""
WITH {_CUM_SQL}, m AS (SELECT {GS}, max(F1) AS mf FROM pr GROUP BY ALL),
co AS (SELECT pr.Model, pr.BASIN, pr.Fold, round_even(min(Thresholds) * 10, 0) / 10 AS t FROM pr
       JOIN m ON pr.Model = m.Model AND pr.BASIN = m.BASIN AND pr.Fold = m.Fold WHERE pr.F1 = m.mf GROUP BY ALL),
s AS (SELECT c.Model, c.BASIN, c.Fold, co.t,
        sum(CASE WHEN score >= t THEN tp_c ELSE 0 END) AS TP, sum(CASE WHEN score >= t THEN fp_c ELSE 0 END) AS FP,
        sum(CASE WHEN score < t THEN tp_c ELSE 0 END) AS FN, sum(CASE WHEN score < t THEN fp_c ELSE 0 END) AS TN
      FROM c JOIN co ON c.Model = co.Model AND c.BASIN = co.BASIN AND c.Fold = co.Fold GROUP BY ALL)
SELECT {GS}, {R('t')} AS Cutoff_Rounded,
  {R('coalesce(TP / nullif(TP + FN, 0), 0)')} AS recall_event, {R('coalesce(TP / nullif(TP + FP, 0), 0)')} AS precision_event,
  {R('coalesce(TN / nullif(TN + FP, 0), 0)')} AS recall_nonevent, {R('coalesce(TN / nullif(TN + FN, 0), 0)')} AS precision_nonevent
FROM s
""", ("scored",))
def q_scores_at_cutoff(spark, sf_dir):
    """Both classes' recall and precision at the rounded F1 cutoff."""
    counts = _counts(spark, sf_dir)
    cut = verify.choose_cutoff(_pr(spark, sf_dir), G, "f1_weighted")
    return verify.scores_at_cutoff(counts, cut, G)


@register("area_under_performance", f"""
WITH {_CUM_SQL},
l AS (SELECT *, lead(Precision) OVER w AS pl, lead(Recall) OVER w AS rl FROM pr
      WINDOW w AS (PARTITION BY {GS} ORDER BY Thresholds DESC))
SELECT {GS}, {R('sum((Precision - pl) * (Recall + rl) / 2)')} AS AUPD FROM l WHERE pl IS NOT NULL GROUP BY ALL
""", ("scored",))
def q_area_under_performance(spark, sf_dir):
    """A14 + W13: signed trapezoid of POD over success ratio per group."""
    return verify.area_under_performance(verify.cumulative_table(_counts(spark, sf_dir), G), G)


_PERF_SQL = f"""
{_CUM_SQL},
perf AS (SELECT *, Recall AS POD, 1 - Precision AS FAR, Precision AS Success_Ratio,
          CASE WHEN Recall = 0 OR Precision = 0 THEN 0.0 ELSE 1 / (1 / Precision + 1 / Recall - 1) END AS CSI,
          Recall / nullif(Precision, 0) AS Bias, round_even(Thresholds * 100, 0) / 100 AS Thresh_Round FROM pr)
"""


def _perf(spark, sf_dir):
    return clean.performance_columns(_pr(spark, sf_dir))


@register("performance_curve_columns", f"""
WITH {_PERF_SQL}
SELECT {GS}, {R('Thresholds')} AS Thresholds, {R('POD')} AS POD, {R('FAR')} AS FAR, {R('Success_Ratio')} AS Success_Ratio,
       {R('CSI')} AS CSI, {R('Bias')} AS Bias, {R('Thresh_Round')} AS Thresh_Round FROM perf
""", ("scored",))
def q_performance_curve_columns(spark, sf_dir):
    """P25: POD, FAR, SR, CSI, bias and rounded threshold on the PR curve."""
    return _perf(spark, sf_dir).select(*G, "Thresholds", "POD", "FAR", "Success_Ratio", "CSI", "Bias",
                                       "Thresh_Round")


@register("max_csi_by_fold", f"""
WITH {_PERF_SQL}
SELECT {GS}, {R('max(CSI)')} AS max_CSI FROM perf GROUP BY ALL
""", ("scored",))
def q_max_csi_by_fold(spark, sf_dir):
    """Largest CSI per model, basin and fold."""
    return verify.max_by_group(_perf(spark, sf_dir), G, "CSI", "max_CSI")


@register("smooth_curve", f"""
WITH {_PERF_SQL}
SELECT {GS}, {R('Thresh_Round')} AS Thresh_Round, {R('avg(POD)')} AS POD, {R('avg(Success_Ratio)')} AS Success_Ratio
FROM perf GROUP BY ALL
""", ("scored",))
def q_smooth_curve(spark, sf_dir):
    """Curve columns averaged per threshold rounded to 0.01."""
    return verify.smooth_curve(_perf(spark, sf_dir), G, "Thresholds", ["POD", "Success_Ratio"])


@register("pick_representative_fold", f"""
WITH {_PERF_SQL},
f AS (SELECT {GS}, max(CSI) AS csi FROM perf GROUP BY ALL),
m AS (SELECT Model, BASIN, quantile_cont(csi, 0.5) AS med FROM f GROUP BY ALL)
SELECT f.Model, f.BASIN, {R('m.med')} AS median_max_CSI,
       min(CASE WHEN f.csi = m.med THEN f.Fold END) AS median_fold,
       arg_min(f.Fold, (f.csi, f.Fold)) AS min_fold, arg_min(f.Fold, (-f.csi, f.Fold)) AS max_fold
FROM f JOIN m ON f.Model = m.Model AND f.BASIN = m.BASIN GROUP BY f.Model, f.BASIN, m.med
""", ("scored",))
def q_pick_representative_fold(spark, sf_dir):
    """Median, minimum and maximum fold by max CSI (idxmin/idxmax)."""
    per_fold = verify.max_by_group(_perf(spark, sf_dir), G, "CSI", "max_CSI")
    return verify.representative_folds(per_fold, ["Model", "BASIN"], "Fold", "max_CSI")


@register("bias_at_max_csi", f"""
WITH {_PERF_SQL},
b AS (SELECT {GS}, arg_max(Bias, (CSI, -Thresholds)) AS Bias, max(CSI) AS CSI FROM perf WHERE CSI IS NOT NULL GROUP BY ALL)
SELECT Model, BASIN, {R('avg(Bias)')} AS mean_Bias, {R('avg(CSI)')} AS mean_CSI FROM b GROUP BY ALL
""", ("scored",))
def q_bias_at_max_csi(spark, sf_dir):
    """Bias at the max-CSI row of each fold, averaged per basin."""
    best = verify.row_at_max(_perf(spark, sf_dir), G, "CSI", "Thresholds", ["Bias", "CSI"])
    return best.groupBy("Model", "BASIN").agg(F.avg("Bias").alias("mean_Bias"), F.avg("CSI").alias("mean_CSI"))


@register("threshold_band", f"""
WITH {_CUM_SQL}, m AS (SELECT {GS}, max(F1) AS mf FROM pr GROUP BY ALL),
co AS (SELECT pr.Model, pr.BASIN, pr.Fold, min(Thresholds) AS cut FROM pr
       JOIN m ON pr.Model = m.Model AND pr.BASIN = m.BASIN AND pr.Fold = m.Fold WHERE pr.F1 = m.mf GROUP BY ALL),
auc AS (SELECT {GS}, sum((FP / nullif(N, 0) - (FP - fp_c) / nullif(N, 0)) * (TP / nullif(P, 0) + (TP - tp_c) / nullif(P, 0)) / 2) AS AUC
        FROM cum GROUP BY ALL)
SELECT co.Model, co.BASIN, {R('min(cut)')} AS min_cutoff, {R('max(cut)')} AS max_cutoff,
       {R('min(AUC)')} AS min_AUC, {R('max(AUC)')} AS max_AUC
FROM co JOIN auc ON co.Model = auc.Model AND co.BASIN = auc.BASIN AND co.Fold = auc.Fold GROUP BY ALL
""", ("scored",))
def q_threshold_band(spark, sf_dir):
    """Range of cutoff and AUC over folds per model and basin."""
    cum = _cum(spark, sf_dir)
    cut = verify.choose_cutoff(_pr(spark, sf_dir, cum), G, "f1_weighted")
    auc = cum.where("pos = 1").select(*G, "AUC")
    j = cut.join(auc, G)
    return j.groupBy("Model", "BASIN").agg(
        F.min("Cutoff_Threshold").alias("min_cutoff"), F.max("Cutoff_Threshold").alias("max_cutoff"),
        F.min("AUC").alias("min_AUC"), F.max("AUC").alias("max_AUC"))


@register("fold_summary", f"""
WITH {_CM_SQL}
SELECT Category_Name, BASIN, Model,
  {', '.join(f"{R(f'quantile_cont({v}, {q})')} AS {v}_{n}" for v in ('POD', 'SR', 'Threat') for q, n in ((0.5, 'median'), (0.025, 'q025'), (0.975, 'q975')))},
  {', '.join(f"{R(f'quantile_cont({v}, 0.5) - quantile_cont({v}, 0.025)')} AS {v}_lower, {R(f'quantile_cont({v}, 0.975) - quantile_cont({v}, 0.5)')} AS {v}_upper" for v in ('POD', 'SR', 'Threat'))}
FROM cms GROUP BY ALL
""", ("scored",))
def q_fold_summary(spark, sf_dir):
    """Median and 2.5/97.5 % of POD, SR, Threat over folds, with error-bar arms."""
    return verify.fold_summary(_cm(spark, sf_dir), ["Category_Name", "BASIN", "Model"], ["POD", "SR", "Threat"])


@register("mean_scores", f"""
WITH {_CM_SQL}
SELECT Category_Name, BASIN, {R('avg(POD)')} AS POD, {R('avg(SR)')} AS SR, {R('avg(Threat)')} AS Threat FROM cms GROUP BY ALL
""", ("scored",))
def q_mean_scores(spark, sf_dir):
    """Mean score per category and basin over models and folds."""
    return _cm(spark, sf_dir).groupBy("Category_Name", "BASIN").agg(
        F.avg("POD").alias("POD"), F.avg("SR").alias("SR"), F.avg("Threat").alias("Threat"))


@register("best_per_model", f"""
WITH {_CM_SQL}
SELECT BASIN, Model, arg_max(Fold, (Threat, -Fold)) AS Fold, {R('max(Threat)')} AS Threat
FROM cms WHERE Category = 1 AND Threat IS NOT NULL GROUP BY ALL
""", ("scored",))
def q_best_per_model(spark, sf_dir):
    """Fold with the best event Threat per basin and model (lowest fold on ties)."""
    cm = _cm(spark, sf_dir).where("Category = 1")
    return verify.row_at_max(cm, ["BASIN", "Model"], "Threat", "Fold", ["Fold", "Threat"])


@register("importance_rank", f"""
WITH {_CM_SQL},
g AS (SELECT BASIN, Model, avg(Threat) AS mean_Threat, max(Threat) AS max_Threat FROM cms WHERE Category = 1 GROUP BY ALL)
SELECT c.BASIN, c.Model, c.Fold, {R('c.Threat')} AS Threat, {R('g.mean_Threat')} AS mean_Threat, {R('g.max_Threat')} AS max_Threat
FROM cms c JOIN g ON c.BASIN = g.BASIN AND c.Model = g.Model WHERE c.Category = 1
""", ("scored",))
def q_importance_rank(spark, sf_dir):
    """Per-group mean and max written onto each row, ranked by the mean."""
    cm = _cm(spark, sf_dir).where("Category = 1").select("BASIN", "Model", "Fold", "Threat")
    return verify.group_mean_max(cm, ["BASIN", "Model"], "Threat")


@register("multi_key_sort", f"""
WITH {_CM_SQL}
SELECT BASIN, Model, Fold, {R('Threat')} AS Threat FROM cms WHERE Category = 1
""", ("scored",))
def q_multi_key_sort(spark, sf_dir):
    """Sort by basin and model ascending, Threat descending."""
    cm = _cm(spark, sf_dir).where("Category = 1").select("BASIN", "Model", "Fold", "Threat")
    return cm.orderBy(F.col("BASIN").asc(), F.col("Model").asc(), F.col("Threat").desc())


@register("nearest_threshold", f"""
WITH {_CUM_SQL}
SELECT {GS}, {R('arg_min(Thresholds, (abs(Thresholds - 0.5), Thresholds))')} AS Thresholds,
       {R('arg_min(Precision, (abs(Thresholds - 0.5), Thresholds))')} AS Precision,
       {R('arg_min(Recall, (abs(Thresholds - 0.5), Thresholds))')} AS Recall
FROM pr GROUP BY ALL
""", ("scored",))
def q_nearest_threshold(spark, sf_dir):
    """T4: PR row whose threshold is nearest 0.5."""
    return verify.nearest(_pr(spark, sf_dir), G, "Thresholds", 0.5, ["Thresholds", "Precision", "Recall"])
