"""Spelling variants: words one edit apart, found by a relational trie frontier.

Method
  1. *Words.* Maximal runs of letters, A-Z lower-cased; counts are combined per
     batch of documents, then over all documents.
  2. *Edge table.* A trie node is the hash of a prefix. The table has every edge
     (node, label, child): labels of one letter, and, from a node whose depth is
     a multiple of 2^k, labels of 2^k letters, so that a state reaches the end
     of a word of L letters in at most 2 log2(L) levels. A second trie holds
     the words reversed.
  3. *Frontier.* A state is (word, position, node, edits). An edit in the second
     half of a word leaves the node of its first half shared, one in the first
     half that of its reversed second half, so states take their edit only from
     the middle on, where a node has few children. States without an edit lie on
     the word's own path. An edit makes a state of one edit: replacing a letter
     joins the edges whose next letter agrees, deleting one stays at the node.
     (Insertions are the deletions of the other word; of two words that differ
     in one letter, the one with the smaller letter finds the other.) Then, level by
     level, the states of one edit are joined with the edge table on (node, label).
  4. *Neighbours.* A state at the end of its word whose node ends a word is
     terminal: the two words are compared once more (a hash of two prefixes
     may collide) and are neighbours in both directions.
  5. *Forms.* The most frequent near word, if it is at least ``ratio`` times as
     frequent; roots by pointer doubling (counts grow along the way, so ways are
     short and have no circles).

Defined results
  null text has no words; a null id is read as empty text by ``rewrite``; repeated
  rows count again; ties of counts go to the word that is first in code-point
  order; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gale.llm.common import Scratch, pick

LETTERS = "a-zÀ-ÿ"


def drop_letter(prefix_crc: int, run: str) -> str:
    """The contract's planted misspellings: one run in 97 of a document loses a letter."""
    h = crc32(run.encode(), prefix_crc)
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count(rewrite: Callable[[int, str], str] | None):
    pattern = re.compile(f"[{LETTERS}]+")

    def run(batches):
        for b in batches:
            counts: Counter = Counter()
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                found = Counter(pattern.findall((text or b"").lower().decode()))  # bytes: only A-Z are lowered
                if rewrite is not None:
                    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in found.items():
                        counts[rewrite(start, word)] += n
                else:
                    counts.update(found)
            yield pa.record_batch({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
    return run


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3,
                rewrite: Callable[[int, str], str] | None = None) -> DataFrame:
    """(word, n) over all (doc_id, text) rows. ``rewrite(crc32 of "<id>:", run)`` may change a run first."""
    return docs.mapInArrow(_count(rewrite), "word string, n long") \
        .filter(F.char_length("word") >= min_length) \
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _paths(words: DataFrame, lowest: int) -> DataFrame:
    """(key, way, depth, node): every node of depth ``lowest`` or more on the path of
    every word (way 0) and of every reversed word (way 1)."""
    both = words.select(F.col("word").alias("key"), F.lit(0).alias("way")) \
        .union(words.select(F.reverse("word"), F.lit(1)))
    return both.select("key", "way", F.explode(F.expr(f"sequence({lowest}, char_length(key))")).alias("depth")) \
        .withColumn("node", F.expr("xxhash64(way, left(key, depth))"))


def _exponent(pos: str) -> str:
    """Largest k such that 2^k divides the depth and 2^k letters are left from ``pos`` on."""
    return f"least(bit_count((depth & -depth) - 1), char_length(bin(char_length(key) - {pos})) - 1)"


def _edges(paths: DataFrame) -> DataFrame:
    """(node, label, child): labels of 2^k letters from depths that 2^k divides."""
    return paths.filter("depth < char_length(key)") \
        .select("key", "way", "depth", "node", F.explode(F.expr(f"sequence(0, {_exponent('depth')})")).alias("k")) \
        .withColumn("stride", F.expr("shiftleft(1, k)")).select("node", F.expr("substr(key, depth + 1, stride)").alias("label"),
                F.expr("xxhash64(way, left(key, depth + stride))").alias("child")).distinct()


def near_pairs(words: DataFrame, scratch: Scratch, min_length: int = 5) -> DataFrame:
    """(word, near): both directions of every pair of words that differ by one
    inserted, deleted or replaced code point. ``words``: column word, distinct."""
    lowest = min_length // 2
    paths = scratch.write(_paths(words.select("word"), lowest), "paths")
    edges = scratch.write(_edges(paths), "edges")
    ends = scratch.write(paths.filter("depth = char_length(key)").select("node", F.col("key").alias("end"), "way"), "ends")
    # own path from the middle on: the first half (way 0) or the second half reversed (way 1) is shared
    middle = "IF(way = 0, char_length(key) div 2, char_length(key) - char_length(key) div 2)"
    open_ = paths.filter(f"depth >= {middle} AND depth < char_length(key)")
    # two letters on from a node: the replaced one and the next (none behind the last)
    pairs = paths.filter("depth < char_length(key)").select(
        "node", F.expr("substr(key, depth + 1, 1)").alias("c"), F.expr("substr(key, depth + 2, 1)").alias("next"),
        F.expr("IF(depth + 1 = char_length(key), 0, 1)").alias("on"),
        F.expr("xxhash64(way, left(key, least(depth + 2, char_length(key))))").alias("child")).distinct()
    s = open_.withColumns({"next": F.expr("substr(key, depth + 2, 1)"), "own": F.expr("substr(key, depth + 1, 1)")})
    replaced = s.join(pairs, ["node", "next"]).filter(F.col("c") > F.col("own")) \
        .select("key", "way", (F.col("depth") + 1 + F.col("on")).alias("pos"), (F.col("depth") + 1 + F.col("on")).alias("depth"),
                F.col("child").alias("node"))
    deleted = open_.select("key", "way", (F.col("depth") + 1).alias("pos"), "depth", "node")
    frontier = scratch.write(replaced.unionByName(deleted), "frontier-0")
    terminal, level = [], 0
    while True:
        terminal.append(frontier.filter("pos = char_length(key)").select("key", "way", "node"))
        going = frontier.filter("pos < char_length(key)")
        if going.isEmpty():
            break
        level += 1
        moved = going.withColumn("stride", F.expr(f"shiftleft(1, {_exponent('pos')})")).withColumn("label", F.expr("substr(key, pos + 1, stride)")) \
            .join(edges, ["node", "label"]) \
            .select("key", "way", (F.col("pos") + F.col("stride")).alias("pos"),
                    (F.col("depth") + F.col("stride")).alias("depth"), F.col("child").alias("node"))
        frontier = scratch.write(moved, f"frontier-{level}")
    states = terminal[0]
    for t in terminal[1:]:
        states = states.unionByName(t)
    found = states.join(ends, ["node", "way"]).filter("key <> end AND levenshtein(key, end) = 1") \
        .select(F.expr("IF(way = 0, key, reverse(key))").alias("word"), F.expr("IF(way = 0, end, reverse(end))").alias("near"))
    return scratch.write(found.union(found.select("near", "word")).distinct(), "near")


def spelling_groups(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2,
                    rewrite: Callable[[int, str], str] | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    if ratio < 2:
        raise ValueError("ratio: 2 or more")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(word_counts(pick(docs, doc_id=id_col, text=text_col), min_length, min_count, rewrite), "words")
    near = near_pairs(words, scratch, min_length)
    frequent = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near") \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                             F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("top"))
    formed = F.col("top.minus") * -1 >= F.col("n") * ratio
    judged = scratch.write(words.join(frequent, "word", "left").select(
        "word", F.when(formed, F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, -F.col("top.minus")).alias("form_n")), "judged")
    scratch.drop("paths", "edges", "ends", "near", *[f"frontier-{i}" for i in range(64)])
    # every step at least doubles the count, so a way has at most 63 of them: six doublings suffice
    ways = judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    for i in range(6):
        nxt = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ways = scratch.write(ways.join(nxt, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), f"ways-{i}")
        if ways.filter("moved").isEmpty():
            break
    return judged.join(ways, "word", "left") \
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
