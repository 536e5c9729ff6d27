import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gale.llm.maxent_lm import SHORT, features, lm_scores, log_probability, run_sums, softmax


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def toks(t):
    return (t or "").encode().lower().split() + [b""]


def base(rows):
    c = Counter()
    for i, t in rows:
        if crc(i) % 10:
            c.update(toks(t))
    n, v = sum(c.values()), len(c)
    den = math.log10(n + 0.1 * (v + 1))
    return [(i, crc(i) % 10 == 0, len(toks(t)), sum(c[w] > 0 for w in toks(t)), n,
             sum(math.log10(c[w] + 0.1) - den for w in toks(t))) for i, t in rows]


@pytest.mark.parametrize("frequent", [100_000, 50, 0])
def test_baseline_against_brute_force(documents, messy, frequent):
    for docs in (documents, messy):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = lm_scores(docs, frequent_words=frequent, rounds=1).collect()
        key = lambda r: (str(r[0]), r[2], r[5])
        got = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
                      for r in got], key=key)
        for g, w in zip(got, sorted(base(rows), key=key), strict=True):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-6)
            assert math.isfinite(g[6]) and g[6] < 0


def test_model_beats_the_baseline_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in lm_scores(docs).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in got)
    assert sum(r["score"] for r in got) / tokens > sum(r["base_score"] for r in got) / tokens + 0.05


def test_class_factor_is_a_distribution():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(1 << 14, 8)).astype(np.float32)
    f = features(np.concatenate([np.zeros(3, np.uint64), rng.integers(1, 2 ** 32, 50, dtype=np.uint64)]))
    assert f.shape == (4, 50) and f.min() >= 0 and f.max() < 1 << 14
    bias = rng.normal(size=8).astype(np.float32)
    p = softmax(w, bias, f)
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    for c in range(8):
        assert np.allclose(np.exp(log_probability(w, bias, f, np.full(50, c))), p[:, c], atol=1e-5)


def test_empty(nothing):
    assert lm_scores(nothing).count() == 0


@pytest.mark.parametrize("longest", [1, 2, SHORT, SHORT + 1, 60])
def test_only_long_runs_are_added_one_by_one(monkeypatch, longest):
    rng = np.random.default_rng(longest)
    n = rng.integers(1, longest + 1, 300)
    first, rows = np.cumsum(n) - n, rng.standard_normal((n.sum(), 8)).astype(np.float32)
    want = np.array([rows[a:a + k].astype(float).sum(0) for a, k in zip(first, n)])
    runs, add = [], np.add

    class Watched:
        @staticmethod
        def reduceat(x, starts, axis):
            runs.append(len(starts))
            return add.reduceat(x, starts, axis=axis)
    with monkeypatch.context() as m:
        m.setattr(np, "add", Watched)
        got = run_sums(rows, first, n)
    assert np.allclose(got, want, atol=1e-5) and (got == np.add.reduceat(rows, first, axis=0)).all()
    assert sum(runs) == (n > SHORT).sum()
