import math
import random

import numpy as np
from pyspark.sql import functions as F

from gale.llm import exact_topk, queries, registry  # noqa: F401
from gale.llm.exact_topk import top_k
from tests.llm.conftest import SMALL

SCHEMA = "vec_id long, embedding array<double>, rank int, row string, weights string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], SCHEMA)


def naive(rows, k=5, scale=256):
    ok = [(no, i, [math.floor(scale * x) for x in v]) for no, (i, v) in enumerate(rows)
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for no, i, q in ok:
        if i is None or i % 50:
            continue
        s = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0) for m, j, c in ok if m != no)[:k]
        out += [(i, r, None if none else j, -score) for r, (score, none, j) in enumerate(s, 1)]
    return sorted(out, key=str)


def got(df, **more):
    return sorted((tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, **more).collect()), key=str)


def random_rows(seed, n, values):
    rng = random.Random(seed)
    return [(i, [rng.choice(values) for _ in range(rng.choice([0, 3, 8, 8, 8]))]) for i in range(n)]


def test_equals_brute_force_with_ties_and_blocks(spark, monkeypatch):
    rows = random_rows(3, 700, [0.0, 0.0, 0.0, 0.25, -0.5, 0.004, -0.001])  # sparse, with many equal scores
    rows += [(50, [0.25] * 8), (50, [0.25] * 8), (None, [0.25] * 8), (100, None), (150, [None, 1.0]), (200, [float("nan")]),
             (250, [float("inf"), 0.0]), (300, []), (7, [1.0] * 11)]
    want = naive(rows)
    assert got(frame(spark, rows).repartition(3)) == want
    monkeypatch.setattr(exact_topk, "CANDIDATE_COMPONENTS", 300)
    monkeypatch.setattr(exact_topk, "QUERY_COMPONENTS", 30)
    assert got(frame(spark, rows).repartition(5)) == want


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (3, [0.5, 0.5])]
    assert got(frame(spark, rows)) == naive(rows) and len(naive(rows)) == 4
    assert got(frame(spark, [(0, [1.0])])) == [] and got(frame(spark, [])) == []
    assert got(frame(spark, [(1, [1.0]), (2, [1.0])])) == []


def test_large_components(spark):
    wide = [(i, [x * 1e5 for x in v]) for i, v in random_rows(5, 120, [0.5, -1.25, 3.0])]  # beyond 32 bits
    assert got(frame(spark, wide)) == naive(wide)
    huge = [(0, [5e6, -5e6]), (1, [5e6, 5e6]), (2, [5e6, -5e6 + 1]), (3, [3.0, 0.0])]  # beyond 2^53
    assert got(frame(spark, huge)) == naive(huge)
    over = got(frame(spark, [(0, [1e300]), (1, [1e300]), (2, [-1e300])]))
    assert [(r[2], r[3]) for r in over] == [(1, 2 ** 63 - 1), (2, -2 ** 63 + 1)]  # saturated


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    out = registry.QUERIES["op12_exact_topk"](spark, SMALL)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    rows = table.collect()
    ids = np.array([r["vec_id"] for r in rows])
    w = np.floor(256 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = sorted((-int(v), int(i)) for v, i in zip(w @ w[q], ids) if i != ids[q])[:5]
        want += [(int(ids[q]), r, i, -v) for r, (v, i) in enumerate(s, 1)]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
