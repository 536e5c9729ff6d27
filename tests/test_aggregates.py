"""Hand-checked aggregates: consensus, class weights, histograms, KDE."""

import math

from gale.operators import explore, reliability


def test_consensus_treats_zero_as_missing(spark):
    cols = ("Model string, Predicted_Basin string, Predicted_Pct double, Observed_Pct double, Observed_No_RI long, "
            "Observed_No_Total long")
    rel = spark.createDataFrame([("m1", "AL", 10.0, 0.0, 0, 4), ("m2", "AL", 10.0, 20.0, 1, 5), ("m3", "AL", 10.0, 40.0, 2, 5)], cols)
    model = spark.createDataFrame([("any", "AL", 10.0, 60.0, 3, 5), ("any", "AL", 20.0, 30.0, 3, 10)], cols)
    out = {(r.Consensus, r.Predicted_Pct): r for r in
           reliability.consensus_reliability(model, rel, {"s12": ["m1", "m2"], "s3": ["m3"]}).collect()}
    assert out[("s12", 10.0)].Observed_Pct == 40.0 and out[("s12", 10.0)].Observed_No_RI == 2.0
    assert out[("s12", 10.0)].n_members == 3 and out[("s3", 10.0)].Observed_Pct == 50.0
    assert out[("s12", 20.0)].Observed_Pct == 30.0 and out[("s12", 20.0)].Observed_No_Total == 10.0


def test_class_weights_with_all(spark):
    lab = spark.createDataFrame([("A", 1), ("A", 0), ("A", 0), ("A", 0), ("B", 1), ("B", 0)], "BASIN string, c int")
    w = {(r.BASIN, r.c): (r.CASES, r.FRAC, r.WEIGHT) for r in explore.class_weights(lab, "BASIN", "c").collect()}
    assert w[("A", 1)] == (1, 0.25, 4.0) and w[("B", 0)] == (1, 0.5, 2.0)
    assert w[("ALL", 1)] == (2, 2 / 6, 3.0) and w[("ALL", 0)][0] == 4


def test_histogram_equal_includes_max(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "v double")
    h = {r.bin: r.n for r in explore.histogram_equal(df, "v", 10).collect()}
    assert sum(h.values()) == 11 and h[9] == 2 and h[0] == 1


def test_kde_matches_formula(spark):
    xs = [1.0, 2.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([("g", x) for x in xs], "grp string, v double")
    out = {r.x: r.density for r in explore.gaussian_kde(df, ["grp"], "v", (0.0, 10.0, 11)).collect()}
    n = len(xs)
    mean = sum(xs) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in xs) / (n - 1))
    h = sd * n ** (-0.2)
    for g in range(11):
        want = sum(math.exp(-0.5 * ((g - x) / h) ** 2) for x in xs) / (n * h * math.sqrt(2 * math.pi))
        assert abs(out[float(g)] - want) < 1e-12


def test_quantiles_and_density_of_hot_values_outliers_and_null_groups(spark):
    """One value with 90 % of the rows, one far outlier, negative and tiny values, a null group."""
    import random

    import numpy as np
    rng = random.Random(4)
    rows = [("hot", 3.25)] * 900 + [("hot", 1e300), ("hot", -1e-300)] + [("hot", rng.gauss(0, 5)) for _ in range(98)]
    rows += [(None, rng.uniform(-1, 1)) for _ in range(301)] + [("one", 7.0), ("same", 2.0), ("same", 2.0), ("gap", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"q00": 0.0, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    got = {r.g: r for r in explore.exact_quantiles(df, ["g"], "v", qs).collect()}
    assert set(got) == {"hot", None, "one", "same"}
    for g, r in got.items():
        vals = [v for k, v in rows if k == g]
        for name, q in qs.items():
            want = float(np.quantile(vals, q))
            assert abs(r[name] - want) <= 1e-9 * max(1, abs(want)), (g, name)
    near = df.where("abs(v) < 100")
    dens = {(r.g, r.x): r.density for r in explore.gaussian_kde(near, ["g"], "v", (-2.0, 4.0, 25)).collect()}
    for g in ("hot", None):
        vals = np.array([v for k, v in rows if k == g and abs(v) < 100])
        h = vals.std(ddof=1) * len(vals) ** -0.2
        for x in np.linspace(-2, 4, 25):
            want = np.exp(-0.5 * ((x - vals) / h) ** 2).sum() / (len(vals) * h * math.sqrt(2 * math.pi))
            assert abs(dens[g, float(x)] - want) < 1e-9
    assert {g for g, _ in dens} == {"hot", None}  # a single value, or equal ones, have no bandwidth


def test_density_shuffles_bins_not_rows(spark):
    from pyspark.sql import functions as F
    df = spark.range(50_000).select(F.lit("g").alias("g"), F.randn(3).alias("v"))
    got = {r.x: r.density for r in explore.gaussian_kde(df, ["g"], "v", (-3.0, 3.0, 7)).collect()}
    vals = [r.v for r in df.collect()]
    n = len(vals)
    mean = sum(vals) / n
    h = math.sqrt(sum((v - mean) ** 2 for v in vals) / (n - 1)) * n ** -0.2
    for x, d in got.items():
        assert abs(d - sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in vals) / (n * h * math.sqrt(2 * math.pi))) < 1e-9
    assert explore.KDE_BINS * (6 / h + 2 * explore.KDE_REACH) < 10 * n


def test_null_groups_are_groups(spark):
    from gale.operators import verify
    rows = [(None, 1, 1, 0.9), (None, 0, 0, 0.2), (None, 0, 1, 0.6), ("a", 1, 0, 0.4), ("a", 0, 0, 0.1)]
    pred = spark.createDataFrame(rows, "m string, y int, yhat int, p double")
    rep = {(r.m, r.label): r.support for r in verify.classification_report(pred, ["m"], "y", "yhat").collect()}
    assert rep[(None, "1")] == 1 and rep[(None, "0")] == 2 and rep[("a", "accuracy")] == 2
    counts = verify.score_counts(pred, ["m"], "y", "p")
    pr = verify.precision_recall_curve(counts, ["m"])
    assert pr.where("m IS NULL").count() == 3 and verify.roc_curve(counts, ["m"]).where("m IS NULL").count() > 1
    cut = verify.choose_cutoff(pr, ["m"], "f1_weighted")
    assert verify.scores_at_cutoff(counts, cut, ["m"]).where("m IS NULL").count() == 1
    lab = spark.createDataFrame([(None, 1), (None, 0), ("A", 0)], "BASIN string, c int")
    w = {(r.BASIN, r.c): r.CASES for r in explore.class_weights(lab, "BASIN", "c").collect()}
    assert w[(None, 1)] == 1 and w[("ALL", 0)] == 2


def test_classes_are_bounded(spark):
    import pytest

    from gale.operators import sampling
    with pytest.raises(ValueError, match="not a class"):
        sampling.class_counts(spark.range(2000), "id")
