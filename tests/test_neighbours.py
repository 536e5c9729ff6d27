"""Exact kNN join and SMOTE against brute force: ties, repeats, hot cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gale.operators import neighbours, sampling
from gale.operators.neighbours import nearest_neighbours, split_cells

COLS = ["a", "b", "c"]


def table(spark, rows):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in rows], "id long, a double, b double, c double")


def naive(rows, k):
    out = []
    x = {i: np.array(v, float) for i, v in rows}
    for i in x:
        d = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in x if j != i)[:k]
        out += [(i, r, j, v) for r, (v, j) in enumerate(d, 1)]
    return sorted(out)


def found(df, k, cap):
    return sorted(tuple(r) for r in nearest_neighbours(df, "id", COLS, k, cap).collect())


def cases():
    rng = random.Random(1)
    grid = [(i, [rng.randrange(6) for _ in COLS]) for i in range(400)]  # many ties and repeats
    wide = [(i, [rng.randrange(1000), rng.randrange(50), rng.randrange(3)]) for i in range(400)]
    # 90 % in one point or in one small cell, a few rows far away
    hot = [(i, [5, 5, 5]) for i in range(300)] + [(1000 + i, [rng.randrange(10 ** 6), 0, 7]) for i in range(30)]
    small = [(i, [500_000 + rng.randrange(4), 500_000 + rng.randrange(4), rng.randrange(4)]) for i in range(360)]
    small += [(1000 + i, [rng.randrange(10 ** 6), rng.randrange(10 ** 6), 0]) for i in range(40)]
    return {"grid": grid, "wide": wide, "hot": hot, "small": small, "line": [(i, [i * i, 0, 0]) for i in range(150)]}


@pytest.mark.parametrize("name", list(cases()))
def test_neighbours_equal_brute_force(spark, monkeypatch, name):
    monkeypatch.setattr(neighbours, "VISITORS", 50)
    rows = cases()[name]
    assert found(table(spark, rows), 3, 24) == naive(rows, 3)


def test_few_rows_nulls_and_no_rows(spark):
    rows = [(1, [0, 0, 0]), (2, [1, 0, 0]), (3, [1, 0, 0])]
    assert found(table(spark, rows), 5, 8) == naive(rows, 5)
    odd = table(spark, rows).union(spark.createDataFrame([(4, None, 0.0, 0.0), (5, 0.0, float("nan"), 0.0)], "id long, a double, b double, c double"))
    assert found(odd, 5, 8) == naive(rows, 5)
    assert found(table(spark, []), 5, 8) == [] and found(table(spark, rows[:1]), 5, 8) == []


def test_cells_are_bounded_and_cover_every_point(spark):
    for name, rows in cases().items():
        distinct = {tuple(v) for _, v in rows}
        points = table(spark, rows).groupBy(F.array(*COLS).alias("x")).agg(F.min("id").alias("pid")).withColumn("ids", F.array("pid"))
        cells, tree = split_cells(points, 3, 24, 3)
        sizes = [r["count"] for r in cells.groupBy("cell").count().collect()]
        assert sum(sizes) == len(distinct) and max(sizes) <= 24, name
        assert tree.where("leaf").count() == len(sizes)


def test_smote_tops_up_the_minority_exactly(spark):
    rng = random.Random(3)
    rows = [(i, 1 if i % 8 == 0 else 0, rng.gauss(0, 1), rng.gauss(0, 2), "s") for i in range(800)]
    rows += [(9001, 1, None, 1.0, "s"), (9002, 0, 1.0, None, "s")]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, storm string")
    out = sampling.smote(df, "id", "y", 1, ["a", "b"], 0.7, cap=16)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    made = list((__import__("collections").Counter(got) - __import__("collections").Counter(rows)).elements())
    assert len(made) == int(0.7 * 700) - 100 and all(r[1] == 1 for r in made)
    assert sum(r[1] == 1 and r[2] is not None for r in got) == int(0.7 * 700)
    x = {r[0]: np.array(r[2:4]) for r in rows if r[1] == 1 and r[2] is not None}
    near = {i: sorted(x, key=lambda j: (float(((x[i] - x[j]) ** 2).sum()), j))[1:6] for i in x}
    for i, _, a, b, _ in made:  # every new row lies between a row and one of its five neighbours
        p = np.array([a, b])
        assert any(abs(np.linalg.norm(p - x[i]) + np.linalg.norm(p - x[j]) - np.linalg.norm(x[i] - x[j])) < 1e-9 for j in near[i])
    assert sampling.smote(df, "id", "y", 7, ["a", "b"]).count() == len(rows)
    assert sampling.smote(df, "id", "y", 1, ["a", "b"], 0.01).count() == len(rows)
