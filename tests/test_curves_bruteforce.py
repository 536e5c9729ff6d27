"""Curves against a direct Python computation on a small fixture with ties."""

import random

from gale.operators import verify


def _fixture(spark, seed=3):
    rnd = random.Random(seed)
    rows = []
    for g, n in (("hot", 600), ("a", 80), ("b", 40)):
        for _ in range(n):
            y = 1 if rnd.random() < 0.3 else 0
            s = round(min(1.0, rnd.random() * 0.7 + 0.3 * y), 2)  # two decimals: many ties
            rows.append((g, y, s))
    return spark.createDataFrame(rows, "g string, y int, p double"), rows


def _curve(rows, g):
    pts = sorted({s for gg, _, s in rows if gg == g}, reverse=True)
    P = sum(y for gg, y, _ in rows if gg == g)
    N = sum(1 - y for gg, y, _ in rows if gg == g)
    out = []
    for t in pts:
        tp = sum(y for gg, y, s in rows if gg == g and s >= t)
        fp = sum(1 - y for gg, y, s in rows if gg == g and s >= t)
        tc = sum(y for gg, y, s in rows if gg == g and s == t)
        fc = sum(1 - y for gg, y, s in rows if gg == g and s == t)
        out.append((t, tp, fp, tc, fc))
    return out, P, N


def test_pr_and_roc_match_direct_computation(spark):
    df, rows = _fixture(spark)
    counts = verify.score_counts(df, ["g"], "y", "p")
    pr = {(r.g, r.Thresholds): r for r in verify.precision_recall_curve(counts, ["g"]).collect()}
    roc = verify.roc_curve(counts, ["g"]).collect()
    for g in ("hot", "a", "b"):
        pts, P, N = _curve(rows, g)
        want = {t: (tp / (tp + fp), tp / P) for t, tp, fp, _, _ in pts}
        got = {t: (r.Precision, r.Recall) for (gg, t), r in pr.items() if gg == g}
        assert set(got) == set(want)
        for t in want:
            assert abs(got[t][0] - want[t][0]) < 1e-12 and abs(got[t][1] - want[t][1]) < 1e-12
        # ROC: scikit-learn keeps the ends and every point whose next step differs
        keep = [i for i in range(len(pts)) if i in (0, len(pts) - 1)
                or (pts[i + 1][3], pts[i + 1][4]) != (pts[i][3], pts[i][4])]
        want_roc = {(pts[i][2] / N, pts[i][1] / P) for i in keep} | {(0.0, 0.0)}
        got_roc = {(r.FPR, r.TPR) for r in roc if r.g == g}
        assert {(round(a, 12), round(b, 12)) for a, b in got_roc} == \
            {(round(a, 12), round(b, 12)) for a, b in want_roc}
        xs = [(0.0, 0.0)] + [(fp / N, tp / P) for _, tp, fp, _, _ in pts]
        auc = sum((x1 - x0) * (y1 + y0) / 2 for (x0, y0), (x1, y1) in zip(xs, xs[1:]))
        got_auc = {r.AUC for r in roc if r.g == g}
        assert len(got_auc) == 1 and abs(got_auc.pop() - auc) < 1e-12


def test_curve_can_stop_at_full_recall(spark):
    df, rows = _fixture(spark)
    counts = verify.score_counts(df, ["g"], "y", "p")
    pr = verify.precision_recall_curve(counts, ["g"], stop_at_full_recall=True).collect()
    for g in ("hot", "a", "b"):
        low = min(s for gg, y, s in rows if gg == g and y == 1)
        assert {r.Thresholds for r in pr if r.g == g} == {s for gg, _, s in rows if gg == g and s >= low}


def test_cutoff_rules(spark):
    df, rows = _fixture(spark)
    counts = verify.score_counts(df, ["g"], "y", "p")
    pr = verify.precision_recall_curve(counts, ["g"])
    f1 = {r.g: r.Cutoff_Threshold for r in verify.choose_cutoff(pr, ["g"], "f1_weighted").collect()}
    eq = {r.g: r.Cutoff_Threshold for r in verify.choose_cutoff(pr, ["g"], "recall_weighted").collect()}
    for g in ("hot", "a", "b"):
        pts, P, _ = _curve(rows, g)
        prs = sorted((t, tp / (tp + fp), tp / P) for t, tp, fp, _, _ in pts)
        f = [(t, 2 * p * r / (p + r) if p + r else None) for t, p, r in prs]
        best = max(v for _, v in f if v is not None)
        assert f1[g] == min(t for t, v in f if v == best)
        cands = [t for t, p, r in prs if p > r]
        assert eq[g] == (min(cands) if cands else None)


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    from gale.operators.explore import exact_quantiles
    rnd = random.Random(11)
    rows = []
    for g, n in (("hot", 900), ("x", 7), ("y", 1)):
        rows += [(g, None if rnd.random() < 0.05 else float(rnd.randint(-50, 50))) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", qs).collect()}
    for g in ("hot", "x", "y"):
        vals = [v for gg, v in rows if gg == g and v is not None]
        for name, q in qs.items():
            assert abs(got[g][name] - float(np.quantile(vals, q))) < 1e-9


def test_all_scope_equals_direct_total(spark):
    df, rows = _fixture(spark)
    df = df.withColumn("BASIN", (df.p * 10).cast("int").cast("string")).withColumn("yhat", (df.p >= 0.5).cast("int"))
    c = verify.class_counts(df, ["g", "BASIN"], "y", "yhat", basin_col="BASIN")
    alls = {(r.g, r.y, r.yhat): r.n for r in c.where("BASIN = 'ALL'").collect()}
    for g in ("hot", "a", "b"):
        for y in (0, 1):
            for yh in (0, 1):
                want = sum(1 for gg, yy, s in rows if gg == g and yy == y and int(s >= 0.5) == yh)
                assert alls.get((g, y, yh), 0) == want
