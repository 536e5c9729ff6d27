"""Fold loop: held-out rows are scored as they are, regularisation follows the fitted rows; weighted F1."""

import random

import pytest

from gale.operators import models, sampling


def _frame(spark, n=240):
    rnd = random.Random(5)
    rows = []
    for k in range(n):
        y = int(rnd.random() < 0.25)
        rows.append((k, y + rnd.gauss(0, 0.6), rnd.gauss(0, 1), y, float(y)))
    return spark.createDataFrame(rows, "k int, x double, z double, c int, label double")


def test_search_prepares_training_parts_only(spark):
    df = _frame(spark)
    seen = []

    def fit(rows, p):
        seen.append((rows.count(), rows.where("c = 1").count()))
        return models.fit_logistic(rows, ["x", "z"], "label", p)
    model, params, score = models.grid_search(
        df, models.logistic_grid([1.0], [20]), fit, "k", "c", "label", k=3, repeats=2, parallelism=1,
        prepare=lambda d: sampling.random_undersample(d, "k", "c", 1))
    assert len(seen) == 7 and all(a == 2 * b for a, b in seen)  # balanced by undersampling
    assert params == {"C": 1.0, "maxIter": 20} and 0.6 < score <= 1
    assert model.transform(df).count() == df.count()


def test_folds_without_a_class_are_an_error(spark):
    df = _frame(spark).where("c = 0")
    with pytest.raises(ValueError):
        models.grid_search(df, models.forest_grid([2], [1]), None, "k", "c", "label", k=3, repeats=1)


def test_null_features_are_an_error(spark):
    df = _frame(spark)
    model = models.fit_forest(df, ["x", "z"], "label", {"maxDepth": 3, "maxFeatures": 1}, trees=3)
    holes = df.selectExpr("k", "if(k = 3, null, x) as x", "z", "c", "label")
    with pytest.raises(Exception):
        model.transform(holes).collect()


def test_weighted_f1(spark):
    rows = [("a", 0, 0, 8), ("a", 0, 1, 2), ("a", 1, 1, 3), ("a", 1, 0, 1), ("b", 0, 0, 5)]
    got = {r["g"]: r["f"] for r in models.weighted_f1(
        spark.createDataFrame(rows, "g string, y int, y_hat int, n long"), ["g"], "f").collect()}
    f0, f1 = 2 * 8 / (10 + 9), 2 * 3 / (4 + 5)
    assert abs(got["a"] - (10 * f0 + 4 * f1) / 14) < 1e-12 and got["b"] == 1


def test_draws_reach_every_position(spark):
    from gale.functions.hashing import md5_number
    h = [r[0] for r in spark.range(2000).select(md5_number("id", seed="os0").alias("h")).collect()]
    assert max(h) > 2 ** 59 and min(h) >= 0 and max(h) < 2 ** 60
