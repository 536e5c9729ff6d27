"""Exact dedup with an extendible-hash index on shared files (DataFrame operations only).

Method
  1. *Insert.* Rows are grouped on (64-bit hash, normalised text): the grouping
     compares the bytes, and copies are collapsed on the map side before the
     shuffle, so a text that a third of all rows share costs one entry per map
     task. Each distinct text becomes one index entry: hash, SHA-256, the id
     that stays, the number of rows.
  2. *Directory.* It starts as one bucket of depth 0 and doubles as long as a
     bucket holds more than ``bucket_rows`` entries; a bucket is split until it
     fits or the largest depth is reached. The directory of 2^depth cells maps
     the leading bits of a hash to its bucket.
  3. *Owner tasks.* Entries are range-partitioned on the hash prefix, so every
     owner task holds whole buckets of one key range, chains the entries whose
     64-bit hashes collide, and writes them as files in the shared folder.
  4. *Probe.* Every row looks up its entry by hash and, inside the chain, by
     SHA-256; AQE splits the probe rows of a hot text over several tasks.

Defined results
  null text is the empty text; null ids never win against an id (a group of
  null ids only has a null ``keep_id``); rows equal in id *and* text are one
  document listed several times: each is listed, exactly one of them is kept;
  an empty table gives an empty result; other columns are ignored by
  :func:`exact_dedup` and passed through by :func:`drop_copies`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gale.llm.common import Scratch, ascii_lower, fresh, pick, shuffle_partitions

MAX_DEPTH = 16  # directory of at most 2^16 cells


def _prefix(bits: int):
    return F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")


def directory(entries: DataFrame, bucket_rows: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Directory by doubling: cell (the first ``depth`` bits) -> bucket, local depth.

    One row per cell of the final directory, at most 2^``max_depth``. The
    smallest depth at which a cell's bucket holds at most ``bucket_rows``
    entries is its local depth.
    """
    n = entries.count()
    depth = 0 if n <= bucket_rows else min(max_depth, math.ceil(math.log2(n / bucket_rows)) + 3)
    cells = entries.groupBy(_prefix(depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth")) \
        .withColumn("bucket", F.expr(f"shiftright(cell, {depth} - local_depth)"))
    fits = levels.groupBy("local_depth", "bucket").agg(F.sum("n").alias("bucket_rows")) \
        .filter((F.col("bucket_rows") <= bucket_rows) | (F.col("local_depth") == depth))
    first = levels.drop("n").join(fits, ["local_depth", "bucket"]) \
        .groupBy("cell").agg(F.min(F.struct("local_depth", "bucket", "bucket_rows")).alias("b"))
    return first.select("cell", F.lit(depth).alias("depth"), "b.local_depth", "b.bucket", "b.bucket_rows")


def build_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                bucket_rows: int = 100_000) -> DataFrame:
    """Write the index; returns it: bucket, local_depth, h, chain, sha, keep_id, group_size."""
    d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    entries = (d.groupBy(F.xxhash64("norm").alias("h"), "norm")
               .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
               .select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"))
    entries = scratch.write(entries, "entries")
    cells = scratch.write(directory(entries, bucket_rows), "directory")
    depth = cells.agg(F.max("depth")).first()[0] or 0
    placed = entries.withColumn("cell", _prefix(depth)).join(
        F.broadcast(cells.drop("depth", "bucket_rows")), "cell")  # at most 2^MAX_DEPTH rows
    # order-preserving bucket start: whole buckets, in key order, per owner task
    start = F.expr(f"shiftleft(bucket, {depth} - local_depth)")
    owned = placed.withColumn("start", start).repartitionByRange(shuffle_partitions(docs.sparkSession), "start")
    chain = Window.partitionBy("start", "h").orderBy("sha")
    index = owned.withColumn("chain", F.row_number().over(chain)) \
        .select("bucket", "local_depth", "h", "chain", "sha", "keep_id", "group_size")
    index = scratch.write(index, "index")
    scratch.drop("entries")
    return index


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col) \
        .withColumn("text", ascii_lower(F.col("text"))) \
        .select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha"))


def _repeated(keys: DataFrame) -> DataFrame:
    """(doc_id, h, sha) of rows that repeat both id and text; normally none."""
    return keys.groupBy("doc_id", "h", "sha").count().filter("count > 1").drop("count")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bucket_rows: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    index = build_index(docs, scratch, id_col, text_col, bucket_rows)
    keys = scratch.write(_keys(docs, id_col, text_col), "keys")
    out = keys.join(index, ["h", "sha"]) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    again = _repeated(keys)
    if not again.isEmpty():
        again = again.withColumnsRenamed({"h": "h2", "sha": "sha2", "doc_id": "id2"})
        same = (F.col("h") == F.col("h2")) & (F.col("sha") == F.col("sha2")) & F.col("doc_id").eqNullSafe(F.col("id2"))
        first = F.row_number().over(Window.partitionBy("h", "sha", "doc_id").orderBy("group_size")) == 1
        out = out.join(again, same, "left_anti").unionByName(
            out.join(again, same, "left_semi").withColumn("kept", F.col("kept") & first))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"),
                      "bucket", "chain")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bucket_rows: int = 100_000) -> DataFrame:
    """``docs`` with all its columns, one row of every group of equal texts."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    index = build_index(docs, scratch, id_col, text_col, bucket_rows)
    keep = index.select("h", "sha", F.col("keep_id").alias("doc_id"))
    h, sha = fresh(docs, "h"), fresh(docs, "sha")
    norm = ascii_lower(F.col(f"`{text_col}`"))
    rows = docs.withColumns({h: F.xxhash64(norm), sha: F.sha2(norm, 256)})
    kept = rows.join(keep, (rows[h] == keep["h"]) & (rows[sha] == keep["sha"])
                     & rows[f"`{id_col}`"].eqNullSafe(keep["doc_id"]), "left_semi")
    again = _repeated(_keys(docs, id_col, text_col))
    if not again.isEmpty():
        same = (kept[h] == again["h"]) & (kept[sha] == again["sha"]) & kept[f"`{id_col}`"].eqNullSafe(again["doc_id"])
        kept = kept.join(again, same, "left_anti").unionByName(
            kept.join(again, same, "left_semi").dropDuplicates([h, sha, id_col]))
    return kept.drop(h, sha)
