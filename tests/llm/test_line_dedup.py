import random
import time
from pathlib import Path

import pytest
import xxhash

from gale.llm import line_dedup as module
from gale.llm.line_dedup import line_dedup, remove_lines
from gale.llm.queries import op10_line_dedup
from tests.llm.conftest import frame


def brute(rows, t, least):
    lines = []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, signed(r[1]))):
        for n, line in enumerate((text or "").split("\n")):
            s = frozenset(w for w in line.lower().replace("\t", " ").split(" ") if w)
            lines.append((i, text, n, s))
    out = {(i, text): [] for i, text, _, _ in lines}
    seen = []
    for i, text, n, s in lines:
        if len(s) >= least:
            if any(len(s & o) * 1.0 >= t * len(s | o) - 1e-9 for o in seen):
                out[i, text].append(n)
            seen.append(s)
    return sorted(((i, len((text or "").split("\n")), tuple(out[i, text])) for i, text in rows), key=str)


def signed(text):
    x = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return x - 2 ** 64 if x >= 2 ** 63 else x


def cases():
    rng = random.Random(3)
    common = [f"c{i}" for i in range(12)]
    lines = [" ".join(rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 30)))
             for _ in range(120)]
    docs = []
    for d in range(150):
        own = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(lines).split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
            own.append(" ".join(w))
        docs.append((d, "\n".join(own)))
    docs += [(500, None), (501, ""), (None, docs[3][1]), (7, docs[7][1]), (8, docs[9][1].upper()), (600, "\n\na b\n")]
    return docs


@pytest.mark.parametrize("table_words", [1 << 20, 40, 0])
def test_against_brute_force(spark, table_words):
    docs = cases()
    got = line_dedup(frame(spark, docs), 0.8, 5, table_words=table_words).collect()
    assert sorted(((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in got), key=str) == brute(docs, 0.8, 5)


def test_given_documents(documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = line_dedup(documents).collect()
    assert sorted(((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in got), key=str) == brute(docs, 0.8, 5)


def test_messy_and_empty(messy, nothing):
    assert line_dedup(messy).count() == messy.count()
    out = remove_lines(messy)
    assert out.columns == messy.columns and out.count() == messy.count()
    assert line_dedup(nothing).count() == 0


def test_lines_are_taken_out(spark):
    docs = [(1, "Keep this line of five words\nand a second line of many words"), (2, "x\nkeep THIS line of five words\nlast"),
            (3, None)]
    got = {r["doc_id"]: r["text"] for r in remove_lines(frame(spark, docs)).collect()}
    assert got == {1: docs[0][1], 2: "x\nlast", 3: None}


def test_short_lines_against_brute_force(spark):
    rng = random.Random(9)
    docs = [(d, "\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 6))) for _ in range(3))) for d in range(80)]
    got = line_dedup(frame(spark, docs), 0.8, 1).collect()
    assert sorted(((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in got), key=str) == brute(docs, 0.8, 1)


def test_the_query_compares_lines_of_any_length(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = op10_line_dedup(spark, "/root/testdata/sf0.001").collect()
    removed = lambda x: tuple(int(i) for i in x.split(",") if i)
    assert sorted(((r["doc_id"], r["n_lines"], removed(r["removed"])) for r in got), key=str) == brute(docs, 0.8, 1)


def test_rare_words_with_equal_low_bits_are_different_words(spark):
    seen, pair = {}, None
    for i in range(1_000_000):
        low = xxhash.xxh64_intdigest(f"rare{i}", 42) & 0x7FFFFFFF
        if low in seen:
            pair = seen[low], f"rare{i}"
            break
        seen[low] = f"rare{i}"
    docs = [(1, f"a b c d e f g {pair[0]}"), (2, f"a b c d e f g {pair[1]}")]  # Jaccard 7/9
    got = line_dedup(frame(spark, docs), 0.8, 5, table_words=0).collect()
    assert all(r["removed"] == [] for r in got)


@pytest.mark.parametrize("table_words", [1 << 20, 0])
def test_crowded_words_against_brute_force(spark, monkeypatch, table_words):
    monkeypatch.setattr(module, "CROWD", 2)
    monkeypatch.setattr(module, "BLOCK", 3)
    docs = cases()
    got = line_dedup(frame(spark, docs), 0.8, 1, table_words=table_words).collect()
    assert sorted(((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in got), key=str) == brute(docs, 0.8, 1)


def test_a_template_does_not_make_all_pairs(spark, monkeypatch):
    docs = [(d, f"one two three four five six seven eight nine n{d}") for d in range(1500)]
    made, verified = [], module._verified
    monkeypatch.setattr(module, "_verified", lambda pairs, *a: made.append(pairs.count()) or verified(pairs, *a))
    got = {r["doc_id"]: r["removed"] for r in line_dedup(frame(spark, docs)).collect()}
    assert got == {d: [0] if d else [] for d in range(1500)}
    assert sum(made) < 10 * len(docs)  # all pairs: 1.1 million


def test_shuffle_files_go_with_the_step_that_wrote_them(spark, monkeypatch):
    monkeypatch.setattr(module, "CROWD", 2)
    dirs = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f for d in dirs for f in d.glob("*/shuffle_*.data")}
    kept = [spark.range(2000).repartition(3) for _ in range(2)]
    assert [k.count() for k in kept] == [2000, 2000]
    start, left, write = held(), [], module.Scratch.write

    def watched(self, df, name, *more):
        out, until = write(self, df, name, *more), time.time() + 5
        while held() - start and time.time() < until:
            time.sleep(0.1)  # files are removed in the background
        left.append((name, len(held() - start)))
        return out
    monkeypatch.setattr(module.Scratch, "write", watched)
    docs = cases()
    got = line_dedup(frame(spark, docs), 0.8, 1).collect()
    assert len(got) == len(docs) and len(left) > 12 and all(n == 0 for _, n in left), left


@pytest.mark.parametrize("passes", [1, 5])
def test_parts_of_the_words_find_the_same_lines(spark, monkeypatch, passes):
    monkeypatch.setattr(module, "PASSES", passes)
    docs = cases()
    got = line_dedup(frame(spark, docs), 0.8, 1).collect()
    assert sorted(((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in got), key=str) == brute(docs, 0.8, 1)


def test_long_lines_of_other_words_are_no_candidates(spark, monkeypatch):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)]
    docs = [(d, " ".join(rng.sample(pool, 200))) for d in range(40)]  # two share about a third of their words
    docs.append((40, docs[7][1].upper().replace(" ", "  \t") + " new"))
    made, verified = [], module._verified
    monkeypatch.setattr(module, "_verified", lambda pairs, *a: made.append(pairs.count()) or verified(pairs, *a))
    got = line_dedup(frame(spark, docs), 0.8, 1).collect()
    assert sorted(((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in got), key=str) == brute(docs, 0.8, 1)
    assert 1 <= sum(made) < 10, made
