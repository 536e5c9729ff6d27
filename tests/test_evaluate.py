"""M15's tables against SQL over the saved store; M14's search resumes where it stopped."""

import random

import duckdb
import pytest

from gale.operators import evaluate, models, search
from gale.operators.evaluate import KEYS


def predictions(spark, n=900):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        basin = "AL" if i % 10 else rng.choice(["EP", "IO"])  # one basin with 90 % of the rows
        y = int(rng.random() < 0.25)
        p = round(min(max(0.3 + 0.3 * y + rng.gauss(0, 0.2), 0.0), 1.0), 2)
        rows.append((i, basin, y, int(p >= 0.5), 1 - p, p, "RF" if i % 2 else "LR", i % 3))
    return spark.createDataFrame(rows, "case_id int, BASIN string, y_true int, y_pred int, p0 double, p1 double, Model string, draw int")


@pytest.fixture(scope="module")
def evaluated(spark):
    store = evaluate.save_predictions(predictions(spark), buckets=8)
    db = duckdb.connect()
    files = [f.removeprefix("file://").removeprefix("file:") for f in store.inputFiles()]
    db.read_parquet(files).create_view("store")
    db.sql("CREATE VIEW sc AS SELECT Model, draw, BASIN, y_true, y_pred, p0, p1 FROM store "
           "UNION ALL SELECT Model, draw, 'ALL', y_true, y_pred, p0, p1 FROM store")
    return store, evaluate.evaluation_tables(store, [0, 1]), db


def same(df, cols, db, sql):
    rnd = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    got = sorted((rnd(r) for r in df.select(*cols).collect()), key=str)
    want = sorted((rnd(r) for r in db.sql(sql).fetchall()), key=str)
    assert got == want and got


def test_store_holds_every_prediction_once(evaluated, spark):
    store, tables, db = evaluated
    assert db.sql("SELECT count(*), count(DISTINCT case_id), sum(CAST(abs(p0 + p1 - 1) > 1e-12 OR y_pred <> CAST(p1 >= 0.5 AS INT) AS INT)) "
                  "FROM store").fetchall() == [(900, 900, 0)]
    same(tables["predictions"], ["case_id", "Predicted_Basin", "p1"], db,
         "SELECT case_id, BASIN, p1 FROM store UNION ALL SELECT case_id, 'ALL', p1 FROM store")


def test_counts_read_the_store_without_an_exchange(evaluated):
    plan = evaluate.prediction_counts(evaluated[0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    cells = evaluated[0].groupBy(*KEYS, "cell").count().agg({"count": "max"}).first()[0]
    assert cells < 900 / 10  # a hot (model, draw, basin) is spread over its cells


def test_tables_equal_sql_over_the_store(evaluated):
    _, t, db = evaluated
    g = "Model, draw, BASIN"
    same(t["contingency"], [*KEYS, "Category", "Hits", "False_Alarms", "Misses", "Correct_Negs", "POD", "Threat"], db, f"""
        SELECT {g}, k, h, fa, mi, n - h - fa - mi, h / nullif(h + mi, 0), h / nullif(h + mi + fa, 0) FROM (
          SELECT {g}, k, count(*) AS n, count(*) FILTER (WHERE y_true = k AND y_pred = k) AS h,
            count(*) FILTER (WHERE y_true <> k AND y_pred = k) AS fa, count(*) FILTER (WHERE y_true = k AND y_pred <> k) AS mi
          FROM sc, (SELECT unnest([0, 1]) AS k) GROUP BY ALL)""")
    same(t["brier"].where("Threshold = 0.3"), [*KEYS, "BS", "BS_ref", "BS_model"], db, f"""
        SELECT {g}, avg((0.3 - y_true) * (0.3 - y_true)), avg(y_true), avg((p1 - y_true) * (p1 - y_true)) FROM sc GROUP BY ALL""")
    same(t["report"].where("label = '1'"), [*KEYS, "precision", "recall", "support"], db, f"""
        SELECT {g}, coalesce(tp / nullif(np, 0), 0), tp / na, CAST(na AS DOUBLE) FROM (SELECT {g}, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp,
          count(*) FILTER (WHERE y_pred = 1) AS np, count(*) FILTER (WHERE y_true = 1) AS na FROM sc GROUP BY ALL)""")
    curve = f"""SELECT {g}, p1, sum(sum(y_true)) OVER w AS tp, sum(count(*)) OVER w AS n FROM sc GROUP BY Model, draw, BASIN, p1
                WINDOW w AS (PARTITION BY {g} ORDER BY p1 DESC)"""
    same(t["precision_recall"], [*KEYS, "Thresholds", "Precision", "Recall"], db, f"""
        SELECT {g}, p1, tp / n, tp / P FROM ({curve}) JOIN (SELECT {g}, sum(y_true) AS P FROM sc GROUP BY ALL) USING ({g})""")
    same(t["roc"].where("FPR = 1"), [*KEYS, "AUC"], db, f"""
        SELECT {g}, sum(CASE WHEN a.p1 > b.p1 THEN 1.0 WHEN a.p1 = b.p1 THEN 0.5 ELSE 0 END) / count(*)
        FROM (SELECT * FROM sc WHERE y_true = 1) a JOIN (SELECT * FROM sc WHERE y_true = 0) b USING ({g}) GROUP BY ALL""")


def test_stacked_rows(evaluated):
    _, t, _ = evaluated
    out = evaluate.stacked({"brier": t["brier"], "predictions": t["predictions"]}, {"brier": ["Threshold"], "predictions": ["case_id"]})
    assert out.columns == ["table", "Model", "draw", "BASIN", "item", "metric", "value"]
    assert out.where("table = 'predictions' AND metric = 'p1' AND BASIN = 'ALL'").count() == 900


def test_search_resumes_and_finds_the_best_points(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, 2000 + i % 4, y, float(y), y + rng.gauss(0, 0.7), rng.gauss(0, 1)) for i, y in ((i, int(rng.random() < 0.3)) for i in range(400))]
    frame = spark.createDataFrame(rows, "id int, year int, c int, label double, a double, b double")
    calls = []

    def fit(rows, p):
        calls.append(p["C"])
        if len(calls) == 7 and not failed:
            failed.append(True)
            raise RuntimeError("executor lost")
        return models.fit_logistic(rows, ["a", "b"], "label", {**p, "maxIter": 20})
    failed = []
    specs = [search.Spec("LR", [{"C": 1.0}, {"C": 1e-6}, {"C": 1.0}], fit)]
    store = search.ResultStore(spark, str(tmp_path / "store"))
    run = lambda s: search.run_search(frame, [(0, [2000]), (1, [2003])], specs, s, key="id", class_col="c", label="label",
                                      year_col="year", k=2, repeats=1, parallelism=1)
    with pytest.raises(Exception, match="executor lost"):
        run(store)
    first = len(store.done())
    assert first == 6  # two folds of draw 0
    again = search.ResultStore(spark, str(tmp_path / "store"))  # a new start over the same folder
    assert run(again) == 12 - first and run(again) == 0
    best = {r["draw"]: (r["point"], r["score"]) for r in search.best_points(again.table(), 2).collect()}
    assert set(best) == {0, 1} and all(p == 0 and s > 0.6 for p, s in best.values())  # ties: the first of equal points
    with pytest.raises(Exception, match="unfinished"):
        search.best_points(again.table(), 3).collect()
    threats = spark.createDataFrame([("LR", 0, 0.4, 2), ("LR", 1, 0.4, 1), ("RF", 0, None, 3)], "model string, draw int, threat double, point int")
    assert {r["model"]: (r["draw"], r["point"]) for r in search.best_draws(threats).collect()} == {"LR": (0, 2), "RF": (0, 3)}


def test_search_needs_both_classes(spark, tmp_path):
    frame = spark.createDataFrame([(i, 2000, 0, 0.0, 1.0) for i in range(20)], "id int, year int, c int, label double, a double")
    with pytest.raises(ValueError):
        search.run_search(frame, [(0, [])], [search.Spec("m", [{}], None)], search.ResultStore(spark, str(tmp_path / "s")),
                          key="id", class_col="c", label="label", year_col="year", k=2, repeats=1)


def test_dealt_values_are_a_permutation(spark):
    from pyspark.sql import functions as F
    for n in (1, 2, 7, 60):
        rows = spark.range(n).select(F.lit("ALL").alias("_scope"), (F.col("id") + 1).alias("_p"), (F.col("id") * 10.0).alias("a"),
                                     F.lit(3.0).alias("b"))
        sizes = rows.groupBy("_scope").agg(F.count("*").alias("_n"))
        dealt = models.dealt_values(rows, sizes, ["a", "b"], 2, 0).collect()
        assert len(dealt) == n
        seen = {}
        for r in dealt:
            for e in r["_dealt"]:
                seen.setdefault((e["_feature"], e["_rep"]), []).append((r["_p"], e["_v"]))
        for (f, rep), got in seen.items():
            assert sorted(v for _, v in got) == [i * 10.0 if f == "a" else 3.0 for i in range(n)]
        if n == 60:
            orders = {rep: [v for _, v in sorted(seen["a", rep])] for rep in (0, 1)}
            assert orders[0] != orders[1] and orders[0] != sorted(orders[0])
