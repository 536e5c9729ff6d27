"""Line dedup: exact set-similarity join on word sets (DataFrame operations only).

A line is the set of its words (lower case, between blanks). A line of at least
``min_words`` different words is removed if an earlier line is similar: Jaccard
``threshold`` or more. Earlier: smaller doc_id (nulls last), then smaller hash
of the text, then smaller line number.

Method
  1. *Rarity.* Words are counted over all documents in ``table_words`` counters,
     by hash. A word's level is the logarithm of its counter, one byte; words go
     by level and hash, rarest first. Any order finds the same lines, so words
     that share a counter only cost time.
  2. *Sets.* Equal lines collapse before and after the shuffle into one row: first
     position, text, size, the ids of the rarest words, a sketch of 128 bits
     (a word turns one over, so that long lines do not fill it).
  3. *Prefix, positional and length filters.* A similar pair shares a word among
     the rarest ``n - ceil(t n) + 1`` words of the larger and the rarest
     ``n - ceil(2 t n / (1 + t)) + 1`` words of the smaller set. Rows meet on the
     word; size bounds, the number of words that can still follow, and the
     number of sketch bits that differ rule out pairs.
  4. *Verify* the exact Jaccard of what is left, by intersection of the words; the
     later set of a similar pair is removed.
     Words with more than ``CROWD`` rows are not joined with themselves at once:
     in each of a few rounds the rows of a word meet only its earliest set (its
     leader), and what that settles is not compared again. One earlier similar
     set is enough, so only sets still open are then compared with all earlier
     ones, dealt into blocks of ``BLOCK`` rows on either side.
  5. Later occurrences of a set are removed too; positions are put together per
     document.

Disk: the words a set is found by are dealt into ``PASSES`` parts by hash, one after the
other, the shuffle files of a step go when its table is written, and the texts of candidate
pairs are looked up in as many parts.

Words meet by 56 bits of their hash and their level and are compared as they are;
a line's size counts 64-bit hashes, and equal lines are found by 64-bit hash of
their lower-case text.

Defined results
  null text is empty (one empty line); rows equal in id and text are one
  document listed several times, each with the same answer; null ids come last;
  empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gale.llm.common import Scratch, fresh, pick, setting, shuffle_partitions

_BLANK = r"[ \t\x0B\f\r]+"
CROWD = 256  # rows of a word that are joined with each other at once
BLOCK = 1024  # rows of a crowded word on one side of a block
ROUNDS = 8  # rounds of leaders at most
FEW = 1 << 16  # pairs whose keys are broadcast
PASSES = 2  # parts of the words, and of the texts, that are shuffled one after the other
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go with the job that wrote them
_LEVELS = 4  # levels per doubling of a counter; 127 at most


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.xxhash64("text").alias("dk"),
                    F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))


def _words(line: str):
    """The words of a line and empty texts. Splitting at one character costs half of what a pattern does."""
    rare = reduce(lambda a, b: a | b, (F.col(line).contains(c) for c in "\t\x0B\f\r"))
    return F.when(rare, F.split(line, _BLANK)).otherwise(F.split(line, " "))


def _position():
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "dk", "line_no")


def _levels(docs: DataFrame, id_col: str, text_col: str, table_words: int) -> bytes:
    """The level of each of ``table_words`` counters, to which words are dealt by hash."""
    levels = np.zeros(table_words, np.uint8)
    if table_words:
        words = _lines(docs, id_col, text_col).select(F.explode(_words("line")).alias("w")).filter("w <> ''")
        counts = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(table_words)).cast("int").alias("at")).count()
        table = counts.select("at", F.least(F.lit(127), F.floor(F.log2("count") * _LEVELS)).cast("int").alias("level")).toArrow()
        levels[table["at"].to_numpy()] = table["level"].to_numpy()
    return levels.tobytes()


def _sets(docs: DataFrame, levels: bytes, scratch: Scratch, t: float, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(key, first, line, n, prefix, low, high) of the different lines; prefix: ids of the rarest words, rarest first."""
    lines = _lines(docs, id_col, text_col).select(F.xxhash64("line").alias("key"), _position().alias("first"), "line") \
        .groupBy("key").agg(F.min("first").alias("first"), F.first("line").alias("line"))
    toks = F.transform(F.array_remove(_words("line"), ""), lambda w: F.xxhash64(w))

    def ident(tok):
        level = F.lit(0)
        if levels:  # a byte of the table, read as a character
            level = F.ascii(F.substring(F.lit(bytearray(levels)), F.pmod(tok, F.lit(len(levels))).cast("int") + 1, 1).cast("string"))
        return F.shiftleft(F.coalesce(level, F.lit(0)).cast("long"), 56).bitwiseOR(tok.bitwiseAND((1 << 56) - 1))

    def bits(half):
        return F.expr(f"aggregate(toks, 0L, (a, x) -> a ^ if((x & 64) = {64 * half}, shiftleft(1L, int(x & 63)), 0L))")

    sets = lines.withColumn("toks", F.array_distinct(toks)) \
        .withColumn("n", F.size("toks")).withColumn("ids", F.sort_array(F.transform("toks", ident))) \
        .select("key", "first", "line", "n", F.expr(f"slice(ids, 1, {_longer(t)})").alias("prefix"),
                bits(0).alias("low"), bits(1).alias("high"))
    return scratch.write(sets, "sets", "zstd").filter(F.col("n") >= min_words)


def _longer(t: float) -> str:
    """How many of its rarest words a set is found by."""
    return f"int(n - ceil({t!r}D * n - 1e-9D) + 1)"


def _need(t: float, a: str, b: str) -> str:
    """Least overlap of similar sets of these sizes (the small term: rounding of t)."""
    return f"int(ceil({t / (1 + t)!r}D * ({a} + {b}) - 1e-9D))"


def _prefix(sets: DataFrame, *more: str) -> DataFrame:
    """id, key, low, high, at (size and place of the id) of the rarest words of each set."""
    return sets.select("key", "low", "high", F.col("n").cast("long").alias("n"), *more, F.posexplode("prefix").alias("i", "id")) \
        .select("id", "key", "low", "high", F.expr("shiftleft(n, 32) | i").alias("at"), *more)


def _near(t: float) -> str:
    """SQL: what rows (ak, al, ah, a) and (bk, bl, bh, b) of one word must meet to be similar, in either order of size;
    the words that can follow bound the place in the smaller set too."""
    an, ai, bn, bi = "shiftright(a, 32)", "(a & 4294967295L)", "shiftright(b, 32)", "(b & 4294967295L)"
    need = _need(t, an, bn)
    return (f"bit_count(al ^ bl) + bit_count(ah ^ bh) <= {an} + {bn} - 2 * {need} AND least({an}, {bn}) >= {t!r}D * greatest({an}, {bn}) - 1e-9D "
            f"AND least({an} - {ai}, {bn} - {bi}) >= {need}")


def _part(c: str, k: int):
    return F.pmod(F.xxhash64(c), F.lit(PASSES)) == k


def _met(sets: DataFrame, keys: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(key, first, line, n) of the sets with these keys, written in ``PASSES`` parts."""
    keys, sets = keys.distinct(), sets.select("key", "first", "line", "n")
    for k in range(PASSES):
        scratch.write(sets.filter(_part("key", k)).join(keys.filter(_part("key", k)), "key", "left_semi"), f"{name}/part={k}", "zstd")
    return sets.sparkSession.read.schema(sets.schema).parquet(*(scratch.path(f"{name}/part={k}") for k in range(PASSES)))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("ak", "bk")).alias("key")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str, t: float) -> DataFrame:
    """Keys with an earlier similar set, of the candidate pairs (a written table, each pair once)."""
    if pairs.count() <= FEW:  # the other texts are not shuffled
        sets = sets.join(F.broadcast(_ends(pairs)), "key", "left_semi")
    one = sets.select(F.col("key").alias("ak"), F.col("n").alias("an"), F.col("first").alias("af"), F.col("line").alias("al"))
    two = sets.select(F.col("key").alias("bk"), F.col("n").alias("bn"), F.col("first").alias("bf"), F.col("line").alias("bl"))
    both = F.size(F.array_intersect(F.array_remove(_words("al"), ""), _words("bl")))
    later = F.when(F.col("af") > F.col("bf"), F.col("ak")).otherwise(F.col("bk"))
    found = []
    for k in range(PASSES):
        similar = pairs.filter(_part("ak", k)).join(one.filter(_part("ak", k)), "ak").join(two, "bk") \
            .filter(both >= F.expr(_need(t, "an", "bn")))
        found.append(scratch.write(similar.select(later.alias("key")).distinct(), f"{name}-{k}"))
    return reduce(DataFrame.union, found).distinct()


def _settled(rows: DataFrame, sets: DataFrame, scratch: Scratch, t: float) -> DataFrame:
    """Keys that the leaders of crowded words settle, round by round."""
    crowd, gone, before = rows, None, rows.count()
    for k in range(ROUNDS):
        lead = scratch.write(crowd.groupBy("id").agg(F.min(F.struct("first", "key", "low", "high", "at")).alias("l"))
                             .select("id", F.col("l.key").alias("bk"), F.col("l.low").alias("bl"),
                                     F.col("l.high").alias("bh"), F.col("l.at").alias("b")), f"lead-{k}")
        led = crowd.select("id", F.col("key").alias("ak"), F.col("low").alias("al"), F.col("high").alias("ah"),
                           F.col("at").alias("a")).join(lead, "id") \
            .filter(f"ak <> bk AND {_near(t)}").select("ak", "bk").distinct()
        led = scratch.write(led, f"led-{k}")
        new = scratch.write(_verified(led, sets, scratch, f"verified-{k}", t), f"settled-{k}")
        gone = new if gone is None else gone.union(new)
        # a leader has met its word's rows; it is still open itself
        crowd = scratch.write(crowd.join(new, "key", "left_anti").join(lead.select("id", "bk"), "id")
                              .filter("key <> bk").select(*rows.columns), f"crowd-{k + 1}")
        scratch.drop(f"lead-{k}", f"led-{k}", f"crowd-{k}")
        after = crowd.count()
        if after == 0 or after > 0.9 * before:
            break
        before = after
    return gone.distinct()


def _blocks(rows: DataFrame, gone: DataFrame, scratch: Scratch, t: float) -> DataFrame:
    """Candidate pairs (ak, bk) of the open sets of crowded words with all earlier sets."""
    probes = scratch.write(rows.join(gone, "key", "left_anti"), "probes")
    parts = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    sizes = probes.groupBy("id").agg(parts.alias("pb"), F.max("first").alias("latest")) \
        .join(rows.groupBy("id").agg(parts.alias("xb")), "id")
    sizes = scratch.write(sizes, "sizes")
    a = probes.join(sizes.drop("latest"), "id").withColumn("p", F.expr("pmod(xxhash64(key), pb)").cast("int")) \
        .select("id", "p", F.explode(F.expr("sequence(0, xb - 1)")).alias("x"), F.col("key").alias("ak"),
                F.col("low").alias("al"), F.col("high").alias("ah"), F.col("at").alias("a"), F.col("first").alias("af"))
    b = rows.join(sizes, "id").filter(F.col("first") < F.col("latest")) \
        .withColumn("x", F.expr("pmod(xxhash64(key), xb)").cast("int")) \
        .select("id", F.explode(F.expr("sequence(0, pb - 1)")).alias("p"), "x", F.col("key").alias("bk"),
                F.col("low").alias("bl"), F.col("high").alias("bh"), F.col("at").alias("b"), F.col("first").alias("bf"))
    return a.join(b, ["id", "p", "x"]).filter(F.col("bf") < F.col("af")).filter(_near(t)).select("ak", "bk")


def _removed(sets: DataFrame, scratch: Scratch, t: float, levels: bytes) -> DataFrame:
    """Keys of the sets that have an earlier similar set."""
    prefix = _prefix(sets)
    # a word of more sets than this has a higher counter (one level less: rounding)
    least = min(127, math.floor(math.log2(CROWD + 1) * _LEVELS)) - 1 if levels else 0
    hot = prefix.filter(F.shiftright("id", 56) >= least).groupBy("id").count().filter(F.col("count") > CROWD)
    hot = scratch.write(hot.select("id"), "hot")
    cold = prefix.join(hot, "id", "left_anti")
    for k in range(PASSES):
        part = cold.filter(_part("id", k)).repartition("id")  # shuffled once for both sides
        pairs = part.toDF("id", "ak", "al", "ah", "a").join(part.toDF("id", "bk", "bl", "bh", "b"), "id") \
            .filter(f"ak < bk AND {_near(t)}").select("ak", "bk")
        scratch.write(pairs.distinct(), f"pairs/part={k}")
    pairs = sets.sparkSession.read.schema("ak long, bk long").parquet(*(scratch.path(f"pairs/part={k}") for k in range(PASSES)))
    pairs = scratch.write(pairs.distinct(), "cold-pairs")
    scratch.drop("pairs")
    keys, crowded = _ends(pairs), not hot.isEmpty()
    if crowded:
        rows = scratch.write(_prefix(sets, "first").join(hot, "id", "left_semi"), "hot-rows")
        keys = keys.union(rows.select("key"))
    met = _met(sets, keys, scratch, "met")
    gone = scratch.write(_verified(pairs, met, scratch, "verified-cold", t), "cold-gone")
    scratch.drop("cold-pairs")
    if crowded:
        settled = _settled(rows, met, scratch, t)
        pairs = scratch.write(_blocks(rows, settled, scratch, t).distinct(), "hot-pairs")
        gone = gone.union(settled).union(_verified(pairs, met, scratch, "verified-hot", t)).distinct()
        gone = scratch.write(gone, "hot-gone")
        scratch.drop("hot-rows", "hot-pairs", "probes", "sizes", *(f"crowd-{k + 1}" for k in range(ROUNDS)))
    scratch.drop("met")
    return gone


def line_dedup(docs: DataFrame, threshold: float = 0.8, min_words: int = 5, id_col: str = "doc_id",
               text_col: str = "text", table_words: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, n_lines, removed (numbers of the removed lines, from 0)."""
    per = _per_document(docs, threshold, min_words, id_col, text_col, table_words)
    return per.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))) \
        .select("doc_id", "n_lines", "removed")


def remove_lines(docs: DataFrame, threshold: float = 0.8, min_words: int = 5, id_col: str = "doc_id",
                 text_col: str = "text", table_words: int = 1 << 20) -> DataFrame:
    """``docs`` with all its columns, the removed lines taken out of the text."""
    per = _per_document(docs, threshold, min_words, id_col, text_col, table_words).filter("size(removed) > 0") \
        .select(F.col("doc_id").alias("r_id"), F.col("dk").alias("r_dk"), "removed")
    text, gone = F.col(f"`{text_col}`"), fresh(docs, "removed")
    rows = docs.join(per.withColumnRenamed("removed", gone), (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("r_dk"))
                     & F.col(f"`{id_col}`").eqNullSafe(F.col("r_id")), "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return rows.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(left)).select(*[f"`{c}`" for c in docs.columns])


def _per_document(docs, threshold, min_words, id_col, text_col, table_words) -> DataFrame:
    """doc_id, dk, n_lines, rows (with this id and text), removed."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    with setting(docs.sparkSession, _CLEAN, "true"):
        levels = _levels(docs, id_col, text_col, table_words)
        sets = _sets(docs, levels, scratch, threshold, id_col, text_col, min_words)
        gone = _removed(sets, scratch, threshold, levels)
        status = sets.select("key", "first").join(gone.withColumn("gone", F.lit(True)), "key", "left")
        status = scratch.write(status, "status")
        scratch.drop("sets")
    lines = _lines(docs, id_col, text_col).select("doc_id", "dk", "line_no", F.xxhash64("line").alias("key"))
    out = lines.join(status, "key", "left").withColumn(
        "out", F.coalesce(F.col("gone") | (_position() > F.col("first")), F.lit(False)))
    return out.groupBy("doc_id", "dk").agg(
        (F.max("line_no") + 1).cast("long").alias("n_lines"), F.count(F.when(F.col("line_no") == 0, 1)).alias("rows"),
        F.array_sort(F.collect_set(F.when(F.col("out"), F.col("line_no")))).alias("removed"))
