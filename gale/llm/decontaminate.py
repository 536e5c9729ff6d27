"""Benchmark decontamination: prefix-filtered set join (DataFrame operations only).

Method
  Words are runs of characters other than ASCII non-alphanumerics, A-Z
  lower-cased. A window is ``window`` consecutive item words (a shorter item is
  one window); it occurs where the same words follow each other in a document.

  1. Windows are taken apart into shingles of five words (an item of fewer
     words is one shingle). One pass over the documents explodes their shingles
     and keeps those that some window has: (document, position, shingle).
  2. The counts of these over all documents order every window's shingles by
     rarity. Exact containment needs all of them, so the necessary prefix is
     the rarest one: only it generates candidates (document, start, window).
  3. Positional and length bounds: the window must begin at or after the first
     word and end at or before the last.
  4. Verify: the shingles that cover the whole window (every fifth, and the last)
     must all be found at the right places, compared as text.

  The shingles of the benchmark are broadcast only below ``broadcast_bytes``
  (their measured size); beyond, the same join runs as a shuffle join.

Defined results
  null or empty text: no words, never hit; items without words have no window;
  items with the same id are one item; null item ids mark words but are not
  listed; repeated documents (same id and text) each get their row; null
  document ids are ids like others; empty tables: nothing is hit or no rows;
  other columns are ignored, in :func:`drop_contaminated` passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gale.llm.common import Scratch, ascii_lower, fresh, pick

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5


def _words(text):
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _grams(words: str, n: str, width: int) -> str:
    """SQL: every run of ``width`` words, joined by a space; none if there are fewer."""
    return (f"IF({n} < {width}, array(), transform(sequence(1, greatest({n} - {width - 1}, 1)), "
            f"i -> array_join(slice({words}, i, {width}), ' ')))")


def _windows(benchmark: DataFrame, scratch: Scratch, window: int, item_col: str, text_col: str):
    """(wid, k, text) distinct windows of k words; (item_id, wid); (wid, k, off, sid) shingles; (sid, token, width)."""
    items = pick(benchmark, item_id=item_col, text=text_col) \
        .select("item_id", _words(F.col("text")).alias("w")).withColumn("n", F.size("w")).filter("n > 0") \
        .withColumn("k", F.least("n", F.lit(window)))
    runs = items.select("item_id", "k", "w", F.explode(F.expr("sequence(1, n - k + 1)")).alias("i")) \
        .select("item_id", "k", F.expr("array_join(slice(w, i, k), ' ')").alias("text"))
    runs = scratch.write(runs, "item-windows")
    windows = scratch.write(runs.select("k", "text").distinct()
                            .withColumn("wid", F.monotonically_increasing_id()), "windows")
    of_item = runs.join(windows, ["k", "text"]).select("item_id", "wid").distinct()
    parts = windows.withColumn("w", F.split("text", " ")).withColumn("width", F.least("k", F.lit(SHINGLE))) \
        .select("wid", "k", "width", "w", F.explode(F.expr("sequence(0, k - width)")).alias("off")) \
        .select("wid", "k", "width", "off", F.expr("array_join(slice(w, off + 1, width), ' ')").alias("token"))
    parts = scratch.write(parts, "parts")
    tokens = scratch.write(parts.select("token", "width").distinct()
                           .withColumn("sid", F.monotonically_increasing_id()), "tokens")
    return windows, of_item, parts.join(tokens, ["token", "width"]).select("wid", "k", "width", "off", "sid"), tokens


def _matched(docs: DataFrame, tokens: DataFrame, scratch: Scratch, id_col: str, text_col: str,
             broadcast_bytes: int) -> DataFrame:
    """Occurrences of benchmark shingles: doc_id, dk, n_words, pos, sid; and one row
    with sid -1 per document row. dk: 64-bit hash of the text."""
    widths = sorted((r[0] for r in tokens.select("width").distinct().collect()), reverse=True)  # 1 to SHINGLE
    size = tokens.agg(F.coalesce(F.sum(F.octet_length("token") + 64), F.lit(0))).first()[0]
    wanted = tokens.select("token", "width", "sid").unionByName(
        docs.sparkSession.sql("SELECT '' AS token, 0 AS width, -1L AS sid"))
    if size <= broadcast_bytes:
        wanted = F.broadcast(wanted)
    d = pick(docs, doc_id=id_col, text=text_col)
    d = d.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("dk"), _words(F.col("text")).alias("w")) \
        .withColumn("n_words", F.size("w"))
    lists = ["array('')"] + [_grams("w", "n_words", k) for k in widths]
    # the lists stand one after the other: a token's place in its own list is its word position
    before = F.lit(1)
    place = F.lit(0)
    for k in widths:
        place = F.when(F.col("width") == k, before).otherwise(place)
        before = before + F.greatest(F.col("n_words") - (k - 1), F.lit(0))
    rows = d.select("doc_id", "dk", "n_words", F.posexplode(F.expr(f"concat({', '.join(lists)})")).alias("at", "token"))
    found = rows.join(wanted, "token") \
        .filter((F.col("width") == 0) | (F.col("at") >= place)) \
        .select("doc_id", "dk", "n_words", (F.col("at") - place).alias("pos"), "sid")
    return scratch.write(found, "matched")


def _occurrences(matched: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified occurrences: doc_id, dk, start, k, wid."""
    seen = matched.filter("sid >= 0")
    rarity = seen.groupBy("sid").agg(F.count(F.lit(1)).alias("freq"))
    ranked = parts.join(rarity, "sid", "left")
    prefix = ranked.groupBy("wid", "k", "width").agg(
        F.min(F.struct("freq", "off", "sid")).alias("p"), F.count("freq").alias("have"), F.count(F.lit(1)).alias("all"))
    prefix = prefix.filter("have = all").select("wid", "k", "width", "p.off", "p.sid")
    prefix = scratch.write(prefix, "prefix")
    candidates = seen.join(prefix, "sid").withColumn("start", F.col("pos") - F.col("off")) \
        .filter("start >= 0 AND start + k <= n_words") \
        .select("doc_id", "dk", "start", "k", "width", "wid").distinct()
    candidates = scratch.write(candidates, "candidates")
    cover = parts.filter("off % width = 0 OR off = k - width").select("wid", "off", "sid")
    need = candidates.join(cover, "wid").withColumn("pos", F.col("start") + F.col("off"))
    there = seen.withColumnsRenamed({c: f"m_{c}" for c in seen.columns})
    ok = need.join(there, need["doc_id"].eqNullSafe(there["m_doc_id"]) & (need["dk"] == there["m_dk"])
                   & (need["pos"] == there["m_pos"]) & (need["sid"] == there["m_sid"]), "left_semi")
    counted = ok.groupBy("doc_id", "dk", "start", "k", "width", "wid").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter("n = ceil(k / width)").select("doc_id", "dk", "start", "k", "wid")


def _find(docs, benchmark, scratch, window, id_col, text_col, item_col, item_text_col, broadcast_bytes):
    _, of_item, parts, tokens = _windows(benchmark, scratch, window, item_col, item_text_col)
    matched = _matched(docs, tokens, scratch, id_col, text_col, broadcast_bytes)
    return matched, of_item, scratch.write(_occurrences(matched, parts, scratch), "occurrences")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    matched, of_item, occ = _find(docs, benchmark, scratch, window, id_col, text_col, item_col, item_text_col,
                                  broadcast_bytes)
    spans = occ.groupBy("doc_id", "dk", "start").agg((F.col("start") + F.max("k")).alias("end"))
    before = Window.partitionBy("doc_id", "dk").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    hits = spans.withColumn("new", new).groupBy("doc_id", "dk").agg(F.sum("new").cast("long").alias("n_hit"))
    names = F.sort_array(F.collect_set(F.col("item_id").cast("string")))  # at most the benchmark's items
    items = occ.select("doc_id", "dk", "wid").distinct().join(of_item, "wid") \
        .groupBy("doc_id", "dk").agg(names.alias("names"))
    found = hits.join(items, hits["doc_id"].eqNullSafe(items["doc_id"]) & (hits["dk"] == items["dk"])) \
        .select(hits["doc_id"].alias("f_id"), hits["dk"].alias("f_dk"), "n_hit", "names")
    rows = matched.filter("sid = -1").select("doc_id", "dk", "n_words")
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["f_id"]) & (rows["dk"] == found["f_dk"]), "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"),
                      F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.size(names).cast("long").alias("n_items"),
                      F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                      F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with all its columns, without the documents in which a window of an item occurs."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    _, _, occ = _find(docs, benchmark, scratch, window, id_col, text_col, item_col, item_text_col, broadcast_bytes)
    bad = scratch.write(occ.select("doc_id", "dk").distinct(), "contaminated")
    scratch.drop("matched", "candidates", "occurrences")
    dk = fresh(docs, "dk")
    rows = docs.withColumn(dk, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return rows.join(bad, (rows[dk] == bad["dk"]) & rows[f"`{id_col}`"].eqNullSafe(bad["doc_id"]), "left_anti").drop(dk)
