import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gale.llm import queries, registry  # noqa: F401
from gale.llm.common import Scratch
from gale.llm.spelling import drop_letter, near_pairs, spelling_groups
from tests.llm.conftest import SMALL, frame


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def naive_pairs(words):
    """Brute force over words that can meet: equal after one deletion, or after one replacement."""
    keys = {}
    for w in words:
        for i in range(len(w)):
            keys.setdefault((i, w[:i] + w[i + 1:]), []).append(w)
    out, known = set(), set(words)
    for (i, rest), same in keys.items():
        out |= {(a, b) for a in same for b in same if a != b}
        if rest in known:
            out |= {(a, rest) for a in same} | {(rest, a) for a in same}
    return out


def counts(rows):
    c = Counter()
    for doc_id, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def naive(rows):
    n = counts(rows)
    near = {w: set() for w in n}
    for a, b in naive_pairs(list(n)):
        near[a].add(b)
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(700)}
    words |= {"x" * n for n in (5, 6, 7, 40, 41)} | {"y" * 300 + t + "z" * 299 for t in ("", "q", "r", "qq")}
    words |= {"a" * 16 + "b" * 16, "a" * 15 + "b" * 16, "a" * 16 + "b" * 15 + "c", "c" + "a" * 15 + "b" * 16}
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    assert want == naive_pairs(sorted(words)) and len(want) > 1000
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    got = [tuple(r) for r in near_pairs(df, Scratch(spark, "test"), 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("shortest", [1, 2, 3])
def test_short_words(spark, shortest):
    rng = random.Random(shortest)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(shortest, 4))) for _ in range(60)}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    got = {tuple(r) for r in near_pairs(df, Scratch(spark, "test"), shortest).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_forms_ties_roots_and_messy_rows(spark, messy, nothing):
    lines = [("hello " * 40, 1), ("hellos " * 20, 2), ("helloss " * 10, 3), ("hellosss " * 5, 4), ("jello " * 40, 5), ("cello " * 3, 6),
             ("abcde " * 3, 7), ("abcdf " * 5, 8), ("Größe GRÖßE größe grösse", 9), ("tiedaa " * 6 + "tiedbb " * 6 + "tiedab " * 3, 10)]
    docs = messy.unionByName(frame(spark, [(1000 + i, t) for t, i in lines] + [(None, "hello hellos")] * 2))
    want = naive([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows_of(spelling_groups(docs, rewrite=drop_letter)) == want
    by = {r[0]: r for r in want}
    assert by["hellosss"][2] == "hello" and by["tiedab"][1] == "tiedaa" and by["abcde"][1] is None
    assert spelling_groups(nothing).count() == 0
    with pytest.raises(ValueError):
        spelling_groups(docs, ratio=1)


def test_query_equals_brute_force(spark, documents):
    out = registry.QUERIES["op13_spelling_variants"](spark, SMALL)
    assert out.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"),
                          ("form_n", "bigint")]
    want = naive([tuple(r) for r in documents.select("doc_id", "text").collect()])
    assert rows_of(out) == want
    assert out.filter(F.col("form").isNotNull()).count() > 10
