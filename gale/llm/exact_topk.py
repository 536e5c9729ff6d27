"""Exact top-k inner products: exhaustive term-at-a-time accumulation.

Method
  1. *Integer rows.* Component x becomes ``floor(scale * x)`` (x as double). A
     row without its zero components is a sparse row of (term, weight), a term
     being the position of the component.
  2. *Blocks.* All rows are dealt into candidate blocks by a hash of their row
     number, the queries into query blocks, both of a bounded number of
     components. Every pair of a query block and a candidate block is one group of
     a co-group, so the work spreads over (query blocks x candidate blocks) tasks,
     each of bounded memory.
  3. *Accumulation.* In a group the candidates become postings: for each term
     the rows that have it, and their weights. For a query, term after term, the
     query's weight times the posting's weights is scattered into a dense array of
     one score per candidate. No candidate is skipped.
  4. *Selection and merge.* The k best of a block are cut out by partial selection
     (ties: smaller id), and the blocks' winners are merged per query by a window
     whose group limit acts before the shuffle.

Defined results
  vectors that are null or hold a null or non-finite component take no part;
  vectors may differ in length (a missing component is zero; an empty vector
  scores 0 with every row); rows with a null id are candidates (in ties after all
  ids) and, as a condition on null is not true, no queries; of rows with equal
  ids each is its own candidate and, if it is one, its own query; components and
  scores beyond 64 bits saturate; empty table: empty result; other columns are
  ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gale.llm.common import Scratch, shuffle_partitions

CANDIDATE_COMPONENTS = 1 << 22  # of one candidate block: 65,536 rows of 64
QUERY_COMPONENTS = 1 << 20      # of one query block
LEAST = np.iinfo(np.int64).min


def _sparse(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero components of a list column, by row."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten())
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    on = flat != 0
    return row[on], term[on], flat[on]


class Postings:
    """For every term its candidate rows and their weights; ``scores`` accumulates a query."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, kind):
        self.n, self.kind, self.lists = n, kind, {}
        order = np.argsort(term, kind="stable")
        term, row, weight = term[order], row[order], weight[order].astype(kind)
        cuts = np.flatnonzero(np.diff(term, prepend=-1, append=-1)) if len(term) else np.zeros(1, int)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            ids, w = row[lo:hi], weight[lo:hi]
            if 2 * len(ids) > n:  # a posting of most rows is kept as a full column
                full = np.zeros(n, kind)
                full[ids] = w
                ids, w = slice(None), full
            self.lists[int(term[lo])] = (ids, w)

    def scores(self, terms: list[int], weights: list[int]) -> np.ndarray:
        acc = np.zeros(self.n, self.kind)
        for t, w in zip(terms, weights):
            if t in self.lists:
                ids, posting = self.lists[t]
                acc[ids] += posting * (w if self.kind is object else self.kind(w))
        if self.kind is object:
            acc = np.array([min(max(int(s), LEAST + 1), -LEAST - 1) for s in acc], np.int64)
        return acc


def best(scores: np.ndarray, k: int, own: int) -> np.ndarray:
    """Positions of the k largest scores, without ``own``; ties: smaller position."""
    if own >= 0:
        scores[own] = np.iinfo(scores.dtype).min
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > cut)
        at = np.concatenate([over, np.flatnonzero(scores == cut)[:k - len(over)]])
    else:
        at = np.arange(len(scores))
    return at[at != own]


def _accumulate(k: int):
    schema = pa.schema([("q_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return schema.empty_table()
        ids = rows.column("vec_id").combine_chunks()
        order = np.lexsort((np.asarray(rows.column("row")), np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())))
        rows = rows.take(order)
        ids, row_no = rows.column("vec_id").combine_chunks(), np.asarray(rows.column("row"))
        place = {r: i for i, r in enumerate(row_no.tolist())}
        c_row, c_term, c_weight = _sparse(rows.column("weights"))
        q_row, q_term, q_weight = _sparse(queries.column("weights"))
        top = [max((abs(int(w.min())), abs(int(w.max())))) if len(w) else 0 for w in (c_weight, q_weight)]
        longest = int(np.bincount(q_row).max()) if len(q_row) else 0
        bound = top[0] * top[1] * longest
        kind = np.int32 if bound < 2 ** 31 - 1 else np.int64 if bound < 2 ** 63 - 1 else object
        if kind is object:
            c_weight = np.array(c_weight.tolist(), object)
        postings = Postings(c_row, c_term, c_weight, len(rows), kind)
        cuts = np.searchsorted(q_row, np.arange(len(queries) + 1))
        out_q, out_at, out_score = [], [], []
        for i, own in enumerate(queries.column("row").to_pylist()):
            part = slice(cuts[i], cuts[i + 1])
            scores = postings.scores(q_term[part].tolist(), q_weight[part].tolist())
            at = best(scores, k, place.get(own, -1))
            out_q.append(np.full(len(at), i))
            out_at.append(at)
            out_score.append(scores[at].astype(np.int64))
        q, at = np.concatenate(out_q), np.concatenate(out_at)
        return pa.table({"q_row": queries.column("row").take(q), "query_id": queries.column("vec_id").take(q),
                         "vec_id": ids.take(at), "score": pa.array(np.concatenate(out_score), pa.int64())}, schema=schema)
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row with ``is_query``, the
    k rows of largest integer inner product, itself left out. Ids are integers."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    x = F.col(f"`{vector_col}`")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    rows = scratch.write(
        vectors.filter(x.isNotNull() & ~odd)
        .select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                F.coalesce(is_query, F.lit(False)).alias("asks"), whole.alias("weights")), "rows")
    size = F.size("weights").cast("long")
    n, total, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)),
                               F.coalesce(F.sum(F.when(F.col("asks"), size + 1)), F.lit(0))).first()
    # as many blocks as memory needs, and at least enough to keep every task slot busy
    c_blocks = max(-(-total // CANDIDATE_COMPONENTS), min(2 * shuffle_partitions(spark), -(-n // 1024)), 1)
    q_blocks = max(-(-asked // QUERY_COMPONENTS), 1)
    place = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = rows.filter("asks").select(place(q_blocks).alias("q_block"), every(c_blocks).alias("c_block"), "row", "vec_id", "weights")
    b = rows.select(every(q_blocks).alias("q_block"), place(c_blocks).alias("c_block"), "row", "vec_id", "weights")
    local = a.groupBy("q_block", "c_block").cogroup(b.groupBy("q_block", "c_block")) \
        .applyInArrow(_accumulate(k), "q_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
