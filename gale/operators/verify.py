"""Forecast verification statistics.

Inputs are prediction rows: group columns (model, basin, fold, ...), the
true class, the predicted class and the event probability. Everything is a
grouped aggregate over (group, class) or (group, distinct score) counts, so
the big table is scanned once with map-side partial aggregation. Curves need
running sums over scores inside a group; those go through
:func:`gale.operators.scan.segmented_scan`, which never puts a whole group in
one task. A null in a group column is a group like any other value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gale.functions.numeric import round_half_even, safe_div
from gale.operators.clean import classify_at_threshold
from gale.operators.scan import _join, segmented_scan

ALL = "ALL"
# Probability grid for the two-level scan over distinct scores: 2^20 cells,
# so one cell holds the distinct scores of a 1e-6 wide interval and the
# per-group offsets table has at most ~1e6 rows whatever the data volume.
SCORE_BUCKET = 1.0 / 2 ** 20


def _zdiv(a: Column, b: Column) -> Column:
    """a / b with 0 for a zero denominator (scikit-learn's zero_division)."""
    return F.coalesce(safe_div(a, b), F.lit(0.0))


# ------------------------------------------------------------------ A31


def with_all_scope(counts: DataFrame, basin_col: str, sum_cols: list[str],
                   other_keys: list[str]) -> DataFrame:
    """Add the 'ALL' scope to a *pre-aggregated* count table by summing
    over basins; rows of the big table are never duplicated."""
    allb = (counts.groupBy(*other_keys).agg(*[F.sum(c).alias(c) for c in sum_cols])
            .withColumn(basin_col, F.lit(ALL)))
    return counts.unionByName(allb.select(*counts.columns))


def class_counts(pred: DataFrame, group_cols: list[str], y_true: str, y_pred: str, *,
                 basin_col: str | None = None) -> DataFrame:
    """(group, y, y_hat) -> n; with ``basin_col`` the ALL scope is added."""
    keys = list(group_cols)
    c = pred.groupBy(*keys, y_true, y_pred).agg(F.count(F.lit(1)).alias("n"))
    if basin_col:
        c = with_all_scope(c, basin_col, ["n"], [k for k in keys if k != basin_col] + [y_true, y_pred])
    return c


# ------------------------------------------------------------------- A7


def contingency_stats(pred: DataFrame, group_cols: list[str], y_true: str, y_pred: str,
                      classes: list[int], names: dict[int, str] | None = None, *,
                      basin_col: str | None = None) -> DataFrame:
    """One-vs-rest table per class: N_predicted, N_actual, Hits,
    False_Alarms, Misses, Correct_Negs, POD, FAR, PFOD, SR, Threat, BIAS.

    Ratios with a zero denominator are null (pandas gives NaN/inf)."""
    counts = class_counts(pred, group_cols, y_true, y_pred, basin_col=basin_col)
    return contingency_from_counts(counts, group_cols, y_true, y_pred, classes, names)


def contingency_from_counts(counts: DataFrame, group_cols: list[str], y_true: str, y_pred: str,
                            classes: list[int], names: dict[int, str] | None = None) -> DataFrame:
    """A7 from a (group, y, y_hat, n) count table (see :func:`class_counts`)."""
    cls = F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("Category")
    x = counts.select("*", cls)
    c, y, yh, n = F.col("Category"), F.col(y_true), F.col(y_pred), F.col("n")
    agg = x.groupBy(*group_cols, "Category").agg(
        F.sum(F.when(yh == c, n).otherwise(0)).cast("bigint").alias("N_predicted"),
        F.sum(F.when(y == c, n).otherwise(0)).cast("bigint").alias("N_actual"),
        F.sum(F.when((y == c) & (yh == c), n).otherwise(0)).cast("bigint").alias("Hits"),
        F.sum(n).cast("bigint").alias("_total"))
    h, npred, nact = F.col("Hits"), F.col("N_predicted"), F.col("N_actual")
    out = agg.withColumns({
        "False_Alarms": npred - h,
        "Misses": nact - h,
        "Correct_Negs": F.col("_total") - npred - nact + h})
    fa, mi, cn = F.col("False_Alarms"), F.col("Misses"), F.col("Correct_Negs")
    out = out.withColumns({
        "POD": safe_div(h, h + mi),
        "FAR": safe_div(fa, fa + h),
        "PFOD": safe_div(fa, fa + cn),
        "SR": safe_div(h, h + fa),
        "Threat": safe_div(h, h + mi + fa),
        "BIAS": safe_div(h + fa, h + mi)}).drop("_total")
    if names:
        m = F.create_map(*[x for k, v in names.items() for x in (F.lit(int(k)), F.lit(v))])
        out = out.withColumn("Category_Name", m[F.col("Category")])
    return out


# ------------------------------------------------------------------- A8


def classification_report(pred: DataFrame, group_cols: list[str], y_true: str, y_pred: str, *,
                          basin_col: str | None = None) -> DataFrame:
    """Precision, recall, f1_score, support per observed class, plus the
    'accuracy', 'macro avg' and 'weighted avg' rows (scikit-learn layout,
    zero_division -> 0)."""
    counts = class_counts(pred, group_cols, y_true, y_pred, basin_col=basin_col)
    return report_from_counts(counts, group_cols, y_true, y_pred)


def report_from_counts(counts: DataFrame, group_cols: list[str], y_true: str, y_pred: str) -> DataFrame:
    """A8 from a (group, y, y_hat, n) count table. Each count row adds to its
    true class (support, hits) and to its predicted class (predictions), so
    the observed labels come out of one aggregate, without a labels join."""
    y, yh, n = F.col(y_true), F.col(y_pred), F.col("n")
    zero = F.lit(0).cast("bigint")
    parts = F.array(
        F.struct(y.alias("c"), n.alias("na"), zero.alias("np"),
                 F.when(y == yh, n).otherwise(zero).alias("tp")),
        F.struct(yh.alias("c"), zero.alias("na"), n.alias("np"), zero.alias("tp")))
    per = (counts.select(*group_cols, F.explode(parts).alias("p")).select(*group_cols, "p.*")
           .groupBy(*group_cols, "c").agg(F.sum("np").alias("np"), F.sum("na").alias("na"),
                                          F.sum("tp").alias("tp")))
    per = per.withColumn("tot", F.sum("na").over(Window.partitionBy(*group_cols)))  # a row per observed class
    p = _zdiv(F.col("tp"), F.col("np"))
    r = _zdiv(F.col("tp"), F.col("na"))
    per = per.withColumns({"precision": p, "recall": r})
    per = per.withColumn("f1_score", _zdiv(2 * F.col("precision") * F.col("recall"),
                                           F.col("precision") + F.col("recall")))
    rows = per.select(*group_cols, F.col("c").cast("string").alias("label"), "precision",
                      "recall", "f1_score", F.col("na").cast("double").alias("support"))
    g = per.groupBy(*group_cols).agg(
        F.sum("tp").alias("tp"), F.first("tot").alias("tot"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        F.sum(F.col("precision") * F.col("na")).alias("wp"),
        F.sum(F.col("recall") * F.col("na")).alias("wr"),
        F.sum(F.col("f1_score") * F.col("na")).alias("wf"))
    acc = _zdiv(F.col("tp"), F.col("tot"))
    tot = F.col("tot").cast("double")
    accuracy = g.select(*group_cols, F.lit("accuracy").alias("label"), acc.alias("precision"),
                        acc.alias("recall"), acc.alias("f1_score"), tot.alias("support"))
    macro = g.select(*group_cols, F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                     F.col("mr").alias("recall"), F.col("mf").alias("f1_score"), tot.alias("support"))
    weighted = g.select(*group_cols, F.lit("weighted avg").alias("label"),
                        _zdiv(F.col("wp"), tot).alias("precision"), _zdiv(F.col("wr"), tot).alias("recall"),
                        _zdiv(F.col("wf"), tot).alias("f1_score"), tot.alias("support"))
    return rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)


# ------------------------------------------------------------------- A9


def brier_table(pred: DataFrame, group_cols: list[str], y_true: str, score: str,
                event: int = 1, steps: int = 10, *, basin_col: str | None = None) -> DataFrame:
    """Brier score of each constant forecast k/steps (k = 0..steps),
    the reference score BS_ref = event rate, and the model's own Brier score
    and skill ``1 - BS_model / BS_ref``.

    The constant forecasts are scored in closed form from three sums per
    group (n, events, squared error of the model): no row is replicated."""
    y = (F.col(y_true) == event).cast("double")
    g = pred.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"),
        F.sum(F.pow(F.col(score) - y, 2)).alias("sse"))
    if basin_col:
        g = with_all_scope(g, basin_col, ["n", "pos", "sse"], [k for k in group_cols if k != basin_col])
    return brier_from_sums(g, group_cols, steps)


def brier_from_sums(g: DataFrame, group_cols: list[str], steps: int = 10) -> DataFrame:
    """A9 from rows, events and the model's squared error (``n``, ``pos``, ``sse``) per group."""
    thr = F.explode(F.array(*[F.lit(k / steps) for k in range(steps + 1)])).alias("Threshold")
    t = g.select("*", thr)
    p, n, pos = F.col("Threshold"), F.col("n").cast("double"), F.col("pos")
    bs = (pos * F.pow(1 - p, 2) + (n - pos) * F.pow(p, 2)) / n
    bs_ref = pos / n
    bs_model = F.col("sse") / n
    return t.select(*group_cols, "Threshold", bs.alias("BS"), bs_ref.alias("BS_ref"),
                    bs_model.alias("BS_model"),
                    (F.lit(1.0) - safe_div(bs_model, bs_ref)).alias("BSS_model"))


# ------------------------------------------------------------- A10 - A14


def score_counts(pred: DataFrame, group_cols: list[str], y_true: str, score: str,
                 event: int = 1, *, basin_col: str | None = None) -> DataFrame:
    """(group, distinct score) -> tp_c (events), fp_c (non-events)."""
    y = (F.col(y_true) == event).cast("bigint")
    c = pred.groupBy(*group_cols, F.col(score).alias("score")).agg(
        F.sum(y).alias("tp_c"), F.sum(1 - y).alias("fp_c"))
    if basin_col:
        c = with_all_scope(c, basin_col, ["tp_c", "fp_c"],
                           [k for k in group_cols if k != basin_col] + ["score"])
    return c


def cumulative_table(counts: DataFrame, group_cols: list[str]) -> DataFrame:
    """TP, FP at threshold = each distinct score (score >= threshold) with the
    descending position, the next lower score's counts (``tp_next``, ``fp_next``), the
    group's totals P, N, number of distinct scores and lowest event score, and the
    area under its ROC curve (W13): everything the curves need, from one scan. Pass
    it as ``cum`` to compute several curves from one materialized table."""
    tp, fp = F.col("tp_c"), F.col("fp_c")
    # twice the area in counts: each score adds fp_c * (2 * TP - tp_c); as doubles, products of counts may pass 64 bits
    x = counts.withColumn("_own", fp.cast("double") * tp)
    cum = segmented_scan(x, group_cols, ["score"], {"TP": tp, "FP": fp}, following={"tp_next": "tp_c", "fp_next": "fp_c"},
                         totals={"P": F.sum("tp_c"), "N": F.sum("fp_c"), "n_scores": F.count(F.lit(1)), "_own_sum": F.sum("_own"),
                                 "min_event_score": F.min(F.when(tp > 0, F.col("score")))},
                         products={"_area": (fp.cast("double"), "TP")}, descending=True, position_col="pos", bucket_width=SCORE_BUCKET)
    area = safe_div(2 * F.col("_area") - F.col("_own_sum"), 2.0 * F.col("P") * F.col("N"))
    return cum.withColumn("AUC", area).drop("_own", "_own_sum", "_area")


def precision_recall_curve(counts: DataFrame, group_cols: list[str], cum: DataFrame | None = None,
                           stop_at_full_recall: bool = False) -> DataFrame:
    """A10: one row per distinct score, with TP/FP counted at score >=
    threshold; P = TP/(TP+FP), R = TP/P_total, F1 = 2PR/(P+R) (null when
    P+R = 0). The (1, 0) end point is not a row. With ``stop_at_full_recall``
    the scores below the lowest event score are left out."""
    c = cum if cum is not None else cumulative_table(counts, group_cols)
    if stop_at_full_recall:
        c = c.where(F.col("score") >= F.col("min_event_score"))
    p = safe_div(F.col("TP"), F.col("TP") + F.col("FP"))
    r = safe_div(F.col("TP"), F.col("P"))
    out = c.select(*group_cols, F.col("score").alias("Thresholds"), p.alias("Precision"),
                   r.alias("Recall"), "pos", "TP", "FP", "P", "N")
    return out.withColumn("F1", safe_div(2 * F.col("Precision") * F.col("Recall"),
                                         F.col("Precision") + F.col("Recall")))


def choose_cutoff(pr: DataFrame, group_cols: list[str], scoring: str = "f1_weighted",
                  cut: str | float = "equal") -> DataFrame:
    """The decision threshold per group.

    f1: lowest threshold with the largest F1; recall/equal: lowest with P > R;
    precision/equal: lowest with R > P; with a numeric ``cut``: lowest whose
    recall (precision) rounded to 0.1 is below 1 - cut. Null when nothing
    qualifies."""
    thr, p, r = F.col("Thresholds"), F.col("Precision"), F.col("Recall")
    if scoring.startswith("f1"):
        best = F.min_by(thr, F.struct(-F.col("F1"), thr))
        return pr.where(F.col("F1").isNotNull()).groupBy(*group_cols).agg(best.alias("Cutoff_Threshold"))
    if scoring.startswith("recall"):
        cond = (p > r) if cut == "equal" else (round_half_even(r, 1) < 1 - float(cut))
    elif scoring.startswith("precision"):
        cond = (r > p) if cut == "equal" else (round_half_even(p, 1) < 1 - float(cut))
    else:
        raise ValueError(scoring)
    return pr.groupBy(*group_cols).agg(F.min(F.when(cond, thr)).alias("Cutoff_Threshold"))


def roc_curve(counts: DataFrame, group_cols: list[str], drop_intermediate: bool = True,
              cum: DataFrame | None = None) -> DataFrame:
    """(FPR, TPR) at each distinct score, descending, after a start
    point (0, 0) whose threshold is the top score + 1, and the trapezoid AUC
    per group. With ``drop_intermediate`` a point is dropped when the step
    out of it equals the step into it (scikit-learn's rule); the area is
    computed over every point (dropping collinear points leaves it equal)."""
    c = cum if cum is not None else cumulative_table(counts, group_cols)
    if drop_intermediate:
        same = (F.col("tp_next") == F.col("tp_c")) & (F.col("fp_next") == F.col("fp_c"))
        c = c.withColumn("_keep", (F.col("pos") == 1) | (F.col("pos") == F.col("n_scores")) | ~same)
    else:
        c = c.withColumn("_keep", F.lit(True))
    point = F.struct(safe_div(F.col("FP"), F.col("N")).alias("FPR"), safe_div(F.col("TP"), F.col("P")).alias("TPR"), F.col("score").alias("Threshold"))
    start = F.struct(F.lit(0.0).alias("FPR"), F.lit(0.0).alias("TPR"), (F.col("score") + 1).alias("Threshold"))
    points = F.when(F.col("pos") == 1, F.array(start, point)).otherwise(F.array(point))
    return c.where("_keep").select(*group_cols, "AUC", F.explode(points).alias("p")).select(*group_cols, "p.*", "AUC")


def scores_at_cutoff(counts: DataFrame, cutoffs: DataFrame, group_cols: list[str]) -> DataFrame:
    """Recall and precision of both classes when the event is
    predicted at score >= round(cutoff, 1)."""
    t = round_half_even("Cutoff_Threshold", 1)
    j = _join(counts, cutoffs.select(*group_cols, t.alias("t")), group_cols, "inner")
    on = classify_at_threshold("score", F.col("t")) == 1
    g = j.groupBy(*group_cols, "t").agg(
        F.sum(F.when(on, F.col("tp_c")).otherwise(0)).alias("TP"),
        F.sum(F.when(on, F.col("fp_c")).otherwise(0)).alias("FP"),
        F.sum(F.when(~on, F.col("tp_c")).otherwise(0)).alias("FN"),
        F.sum(F.when(~on, F.col("fp_c")).otherwise(0)).alias("TN"))
    tp, fp, fn, tn = (F.col(x) for x in ("TP", "FP", "FN", "TN"))
    return g.select(*group_cols, F.col("t").alias("Cutoff_Rounded"),
                    _zdiv(tp, tp + fn).alias("recall_event"), _zdiv(tp, tp + fp).alias("precision_event"),
                    _zdiv(tn, tn + fp).alias("recall_nonevent"), _zdiv(tn, tn + fn).alias("precision_nonevent"))


def area_under_performance(cum: DataFrame, group_cols: list[str]) -> DataFrame:
    """Signed trapezoid of POD (recall) over success ratio (precision),
    rows by threshold ascending, i.e. each row of the cumulative table
    (:func:`cumulative_table`) paired with the next lower threshold."""
    tp, fp = F.col("TP"), F.col("FP")
    tp_low, fp_low = tp + F.col("tp_next"), fp + F.col("fp_next")
    p, p_low = safe_div(tp, tp + fp), safe_div(tp_low, tp_low + fp_low)
    r, r_low = safe_div(tp, F.col("P")), safe_div(tp_low, F.col("P"))
    pairs = cum.where(F.col("tp_next").isNotNull())
    return pairs.groupBy(*group_cols).agg(F.sum((p - p_low) * (r + r_low) / 2).alias("AUPD"))


# -------------------------------------------------------------- A18 - A24


def fold_summary(stats: DataFrame, group_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Median and 2.5 / 97.5 % quantiles (linear interpolation) of
    per-fold statistics, with the error-bar arms. Input has one row per fold,
    so the exact percentile buffers stay small."""
    aggs = []
    for v in value_cols:
        aggs += [F.percentile(v, 0.5).alias(f"{v}_median"), F.percentile(v, 0.025).alias(f"{v}_q025"),
                 F.percentile(v, 0.975).alias(f"{v}_q975")]
    out = stats.groupBy(*group_cols).agg(*aggs)
    return out.withColumns({
        **{f"{v}_lower": F.col(f"{v}_median") - F.col(f"{v}_q025") for v in value_cols},
        **{f"{v}_upper": F.col(f"{v}_q975") - F.col(f"{v}_median") for v in value_cols}})


def max_by_group(df: DataFrame, group_cols: list[str], value: str, out_col: str | None = None) -> DataFrame:
    """Max of ``value`` per group."""
    return df.groupBy(*group_cols).agg(F.max(value).alias(out_col or f"max_{value}"))


def smooth_curve(df: DataFrame, group_cols: list[str], x: str, cols: list[str], digits: int = 2,
                 out_x: str = "Thresh_Round") -> DataFrame:
    """Mean of curve columns per rounded x."""
    return (df.withColumn(out_x, round_half_even(x, digits))
            .groupBy(*group_cols, out_x).agg(*[F.avg(c).alias(c) for c in cols]))


def representative_folds(per_fold: DataFrame, group_cols: list[str], fold_col: str,
                         value: str) -> DataFrame:
    """Folds whose value is the median (lowest such fold; null when
    no fold equals the median), the minimum and the maximum (lowest fold on
    ties)."""
    f, v = F.col(fold_col), F.col(value)
    med = per_fold.groupBy(*group_cols).agg(F.percentile(value, 0.5).alias("_med"))
    j = per_fold.join(med, group_cols)
    return j.groupBy(*group_cols).agg(
        F.first("_med").alias(f"median_{value}"),
        F.min(F.when(v == F.col("_med"), f)).alias("median_fold"),
        F.min_by(f, F.struct(v, f)).alias("min_fold"),
        F.min_by(f, F.struct(-v, f)).alias("max_fold"))


def row_at_max(df: DataFrame, group_cols: list[str], value: str, tie: str,
               cols: list[str]) -> DataFrame:
    """The row with the largest ``value`` per group (lowest
    ``tie`` on ties), as an aggregate (``max_by``), not a sort."""
    key = F.struct(F.col(value), -F.col(tie))
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), key)
    return df.where(F.col(value).isNotNull()).groupBy(*group_cols).agg(best.alias("_b")).select(
        *group_cols, *[F.col("_b." + c).alias(c) for c in cols])


def nearest(df: DataFrame, group_cols: list[str], x: str, target: float, cols: list[str]) -> DataFrame:
    """T4: the row whose ``x`` is nearest ``target`` (lowest x on ties)."""
    key = F.struct(F.abs(F.col(x) - F.lit(target)), F.col(x))
    best = F.min_by(F.struct(*[F.col(c) for c in cols]), key)
    return df.groupBy(*group_cols).agg(best.alias("_b")).select(
        *group_cols, *[F.col("_b." + c).alias(c) for c in cols])


def group_mean_max(df: DataFrame, group_cols: list[str], value: str) -> DataFrame:
    """Mean and max of ``value`` per group written onto each row
    (grouped aggregate joined back), ordered by the mean."""
    g = df.groupBy(*group_cols).agg(F.avg(value).alias(f"mean_{value}"), F.max(value).alias(f"max_{value}"))
    return df.join(g, group_cols).orderBy(F.col(f"mean_{value}").desc(), *group_cols)
