import hashlib
import re

from gale.llm.decontaminate import decontaminate, drop_contaminated
from tests.llm.conftest import SMALL, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return WORD.findall(low)


def brute(docs, items, window):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for item, text in items:
            b = words(text)
            k = min(window, len(b))
            for s in range(len(b) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == b[s:s + k]:
                        hit |= set(range(p, p + k))
                        if item is not None:
                            names.add(str(item))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=str)


def run(docs, items, window, **kw):
    got = decontaminate(docs, items, window, **kw).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
                   for r in got), key=str)


def cases(spark):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten + " eleven twelve"), (2, "Alpha BETA gamma"), (2, "a b c d e f"), (3, ""), (4, None), (10, "solo"),
             (5, "one two three four five six seven eight nine ten"), (None, "null item words here now again"),
             (6, "r r r r r r r r r r r r")]
    docs = [(1, f"x {ten} y"), (2, "alpha, beta; gamma!"), (2, "alpha beta"), (3, None), (4, ""),
            (5, "one two three four five six seven eight nine eleven ten"), (None, "a b c d e f g solo"),
            (6, "r " * 25), (7, f"{ten} eleven {ten} eleven twelve"), (7, f"{ten} eleven {ten} eleven twelve"),
            (8, "null item words here now again"), (9, "Alpha2 beta gamma alpha beta gamma"), (11, "é solo")]
    return docs, items


def test_against_brute_force(spark, nothing):
    docs, items = cases(spark)
    d = frame(spark, docs)
    b = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, wid long, token string")
    want = brute(docs, items, 10)
    assert run(d, b, 10) == want
    assert run(d, b, 10, broadcast_bytes=-1) == want  # the join without a broadcast
    assert run(nothing, b, 10) == []
    assert run(d, b.limit(0), 10) == brute(docs, [], 10)


def test_filter_drops_exactly_the_hit_documents(spark):
    docs, items = cases(spark)
    d, b = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    bad = {(i, t) for (i, t) in docs if brute([(i, t)], items, 10)[0][5]}
    out = drop_contaminated(d, b, 10)
    assert out.columns == d.columns
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str) == sorted(
        [x for x in docs if x not in bad], key=str)


def test_messy_documents(spark, messy):
    b = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate(messy, b).count() == messy.count()


def test_long_windows_are_verified_word_by_word(spark):
    """Both ends of a window with other words between them, where the shingles between are the frequent ones."""
    for window in (7, 13, 23):
        w = [f"w{i}" for i in range(window)]
        docs = [(1, " ".join(w))] + [(10 + i, " ".join(w[1:-1])) for i in range(4)]
        docs += [(100 + i, " ".join(w[:i] + ["other"] + w[i + 1:])) for i in range(window)]
        docs.append((200, " ".join(w[:5] + ["other"] * (window - 10) + w[max(5, window - 5):])))
        items = [(1, " ".join(w)), (2, " ".join(w[:6])), (3, " ".join(w + ["tail"]))]
        got = run(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window)
        assert got == brute(docs, items, window)
