import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from gale.llm import queries, registry  # noqa: F401
from gale.llm.periodic_runs import collapsed, find_runs, occurrences, repeat_tail, runs
from tests.llm.conftest import SMALL


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if all(w[i] == w[i - p] for i in range(p, len(w))))


def naive_runs(w, least=6, exponent=4):
    out, n = set(), len(w)
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(least, exponent * q) and smallest_period(w[start:j]) == q:
                out.add((start, length, q))
            i = j
    return sorted(out)


def planted(doc_id, words):
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def naive_row(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    found = naive_runs(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for trial in range(1500):
        n, letters = rng.randint(0, 60), rng.randint(1, 4)
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):  # planted repetitions, with some broken words
            a, p = rng.randrange(n + 1), rng.randint(1, 9)
            w[a:] = (w[a:a + p] * n)[:len(w) - a]
        if w and trial % 3 == 0:
            w[rng.randrange(len(w))] = 99
        assert runs(np.array(w, np.int64)) == naive_runs(w), w
        least, exponent = rng.choice([(1, 3), (6, 3), (20, 4), (4, 5), (30, 6)])
        assert runs(np.array(w, np.int64), least, exponent) == naive_runs(w, least, exponent), (w, least, exponent)


def test_work_stays_small_where_words_repeat():
    n = 200_000
    same = np.zeros(n, np.int64)
    assert runs(same) == [(0, n, 1)]
    assert len(occurrences(same, 6, 4)) < 2 * n  # not the n * n / 2 pairs of equal words
    coin = np.random.default_rng(1).integers(0, 2, n)
    assert len(occurrences(coin, 6, 4)) < 2 * n
    long = np.tile(np.arange(30_000), 5)
    assert runs(long) == [(0, 150_000, 30_000)]


def test_collapse_keeps_the_first_period():
    w = "x a b a b a b a b y".split()
    found = naive_runs(w)
    assert found == [(1, 8, 2)]
    assert collapsed([c.encode() for c in w], found) == b"x a b y"
    assert repeat_tail("", []) == []


def test_messy_and_empty_tables(messy, nothing):
    extra = [(21, "go " * 6), (22, "go go go go go"), (23, "a b " * 4 + "a"), (24, "é é " * 9), (25, "A a A a A a A a")]
    docs = messy.select("doc_id", "text").union(messy.sparkSession.createDataFrame(extra, "doc_id long, text string"))
    rows = docs.collect()
    got = find_runs(docs, rewrite=repeat_tail).collect()
    want = []
    for r in rows:
        words = planted(r["doc_id"], (r["text"] or "").encode().split())
        if len(words) < 5000:
            want.append((r["doc_id"], len(words), naive_runs(words)))
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in got if r["n_words"] < 5000), key=str) \
        == sorted(want, key=str)
    assert len(got) == len(rows)
    clash = messy.withColumnRenamed("h", "runs").withColumnRenamed("sha", "collapsed")
    assert find_runs(clash).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert find_runs(clash).count() == messy.count() and find_runs(nothing).count() == 0


def test_query_equals_brute_force(spark, documents):
    got = registry.QUERIES["op11_periodic_runs"](spark, SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if c not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    short = documents.filter("n_chars < 6000").select("doc_id", "text").collect()
    rows = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert len(rows) == documents.count() and sum(r[1] > 0 for r in rows.values()) > 5
    for r in short:
        assert rows[r["doc_id"]] == naive_row(r["doc_id"], r["text"])
    assert all(r[6] and r[7] for r in rows.values())
    assert got.filter(F.col("n_runs") == 0).filter("start IS NOT NULL OR length IS NOT NULL OR period IS NOT NULL "
                                                   "OR exponent_milli IS NOT NULL").isEmpty()
