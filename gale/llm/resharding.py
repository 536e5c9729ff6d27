"""Minimum-cost-flow resharding: few bytes move when the number or size of shards changes.

Method
  1. The sizes of the old shards (one row per shard) and the capacities of the
     new ones form a transport network: keeping a byte where it is costs 0,
     moving it costs 1 (or ``cost[i][j]``). With these costs the free arcs, each shard to
     itself, are filled first (no cheaper flow leaves one unused), and what is left,
     surplus against room, costs the same whatever the way, so one pass in order
     solves it. Given costs are solved by successive shortest paths.
  2. Every old shard is a line of documents in blocks of about ``block_rows``
     rows and ``block_bytes`` bytes, dealt by a hash of id and text. Block totals and their prefix sums
     place each block on the line, a running sum inside the block places each
     document: no task ever orders a whole shard.
  3. The flow cuts every line into block transfers, one interval per receiving
     shard; a document goes where its middle byte lies. A shard differs from
     its capacity by at most half a document per cut. All this runs on (id,
     hash, size) alone and ends in the table of pieces: which rows of which block
     go to which shard, from which slot on.
  4. The files of affected shards are rewritten (a shard that keeps all its
     rows and gets none is left alone): the documents are shuffled once, by
     block, and every task writes the pieces of its blocks.

Defined results
  null text has no bytes (its size is ``overhead``); null and repeated ids:
  every input row is placed once (rows equal in id and text share a block); equal
  documents are interchangeable; empty table: empty result; other columns
  travel with their row, clashing names included.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gale.llm.common import Scratch, fresh


def netted_flow(supply: list[int], capacity: list[int]) -> np.ndarray:
    """:func:`min_cost_flow` for the cost of 1 for every byte that moves: linear in the shards."""
    flow = np.zeros((len(supply), len(capacity)), np.int64)
    left, room = list(map(int, supply)), list(map(int, capacity))
    for i in range(min(len(left), len(room))):
        flow[i, i] = min(left[i], room[i])
        left[i] -= int(flow[i, i])
        room[i] -= int(flow[i, i])
    j = 0
    for i, amount in enumerate(left):
        while amount > 0 and j < len(room):
            part = min(amount, room[j])
            if part:
                flow[i, j] += part
                amount, room[j] = amount - part, room[j] - part
            j += not room[j]
    return flow


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Bytes from each old to each new shard, at the least total cost (sum of
    supply = sum of capacity). Successive shortest paths over the shard table."""
    left, room = np.array(supply, np.int64), np.array(capacity, np.int64)
    flow = np.zeros(cost.shape, np.int64)
    while left.sum() > 0 and room.sum() > 0:
        old = np.where(left > 0, 0.0, np.inf)
        new, via_old, via_new = np.full(len(room), np.inf), np.zeros(len(room), int), np.full(len(left), -1)
        while True:  # shortest distances; a used arc can be walked backwards
            ahead = old[:, None] + cost
            best = ahead.min(0)
            if not (best < new - 1e-9).any():
                break
            via_old = np.where(best < new - 1e-9, ahead.argmin(0), via_old)
            new = np.minimum(new, best)
            back = np.where(flow > 0, new[None, :] - cost, np.inf)
            closer = back.min(1) < old - 1e-9
            via_new = np.where(closer, back.argmin(1), via_new)
            old = np.where(closer, back.min(1), old)
        j = int(np.where(room > 0, new, np.inf).argmin())
        path, at = [], j
        while True:
            i = int(via_old[at])
            path.append((i, at, 1))
            if via_new[i] < 0:
                break
            at = int(via_new[i])
            path.append((i, at, -1))
        amount = min([int(left[i]), int(room[j])] + [int(flow[a, b]) for a, b, s in path if s < 0])
        for a, b, s in path:
            flow[a, b] += s * amount
        left[i] -= amount
        room[j] -= amount
    return flow


def capacities(total: int, shards: int, weights: list[float] | None = None) -> list[int]:
    """``total`` split in proportion to ``weights`` (equal ones by default), in whole bytes."""
    w = np.ones(shards) if weights is None else np.asarray(weights, float)
    edge = np.floor(total * np.concatenate([[0.0], np.cumsum(w) / w.sum()])).astype(np.int64)
    edge[-1] = total
    return np.diff(edge).tolist()


def _intervals(flow: np.ndarray) -> list[tuple[int, float, float, int]]:
    """(old, from, to, new): the cuts of every old shard's line, the kept part first."""
    out = []
    for i in range(flow.shape[0]):
        to = sorted(np.flatnonzero(flow[i] > 0).tolist(), key=lambda j: (j != i, j))
        at = 0
        for k, j in enumerate(to):
            lo, at = at, at + int(flow[i, j])
            out.append((i, float("-inf") if k == 0 else float(lo), float("inf") if k == len(to) - 1 else float(at), j))
    return out


def _placed(rows: DataFrame, names: DataFrame, old: str, cols: dict[str, str]) -> DataFrame:
    """``rows`` with their block, the bytes up to them and their number in the block.

    ``cols``: names of the columns id, dk, size, no, block, upto, nth."""
    c = {k: F.col(f"`{v}`") for k, v in cols.items()}
    place = F.xxhash64(c["dk"], c["id"])
    name, blocks = fresh(rows, "name"), fresh(rows, "blocks")
    names = names.toDF(name, cols["no"], blocks)
    numbered = rows.join(F.broadcast(names), F.col(f"`{old}`").eqNullSafe(F.col(name))) \
        .withColumn(cols["block"], F.pmod(place, F.col(blocks))).drop(name, blocks)
    inside = Window.partitionBy(c["no"], c["block"]).orderBy(place, c["dk"], c["id"])
    return numbered.withColumns({
        cols["upto"]: F.sum(c["size"]).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        cols["nth"]: F.row_number().over(inside)})


def reshard(docs: DataFrame, old_col: str, shards: int, weights: list[float] | None = None, cost: np.ndarray | None = None,
            id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, block_rows: int = 20_000,
            block_bytes: int = 8 << 20) -> dict:
    """Rewrites ``docs`` from the shards in ``old_col`` into ``shards`` new ones.

    Returns ``flow`` (bytes from old to new), ``moved_bytes``, ``affected``
    (rewritten shards), ``old`` (names of the old shards, in order), ``path``
    and ``rows``: the new layout, all columns of ``docs`` beside ``shard_col``
    and ``slot_col`` (their names are in the result).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resharding")
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead
    dk = F.xxhash64(F.coalesce(text, F.lit("")))
    slim = scratch.write(docs.select(F.col(f"`{old_col}`").cast("string").alias("old"),
                                     F.col(f"`{id_col}`").alias("doc_id"), dk.alias("dk"), size.alias("size")), "slim")
    sizes = slim.groupBy("old").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")) \
        .orderBy("old").collect()  # one row per old shard
    supply = [r["bytes"] for r in sizes]
    room = capacities(sum(supply), shards, weights)
    flow = netted_flow(supply, room) if cost is None else min_cost_flow(supply, room, cost)
    names = spark.createDataFrame([(r["old"], i, max(-(-r["rows"] // block_rows), -(-r["bytes"] // block_bytes)))
                                   for i, r in enumerate(sizes)], "name string, old_no int, blocks long")
    cuts = spark.createDataFrame(_intervals(flow), "old_no int, lo double, hi double, shard int")

    # the table of pieces, from ids, hashes and sizes
    plain = {"id": "doc_id", "dk": "dk", "size": "size", "no": "old_no", "block": "block", "upto": "upto", "nth": "nth"}
    inside = scratch.write(_placed(slim, names, "old", plain).select("old_no", "block", "upto", "nth", "size"), "inside")
    before = Window.partitionBy("old_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = inside.groupBy("old_no", "block").agg(F.sum("size").alias("bytes")) \
        .select("old_no", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    middle = F.col("base") + F.col("upto") - F.col("size") / 2
    cut = inside.join(starts, ["old_no", "block"]).withColumn("middle", middle) \
        .join(F.broadcast(cuts), "old_no").filter("middle >= lo AND middle < hi")
    earlier = Window.partitionBy("shard").orderBy("old_no", "block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut.groupBy("shard", "old_no", "block").agg(F.count(F.lit(1)).alias("rows"), F.min("nth").alias("from")) \
        .withColumn("first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    pieces = scratch.write(pieces.select("old_no", "block", "shard", "from", (F.col("from") + F.col("rows")).alias("to"),
                                         "first"), "pieces")

    # the documents, shuffled once by block
    affected = [j for j in range(shards)
                if not (j < len(sizes) and flow[j, j] == supply[j] and (flow[:, j] > 0).sum() <= 1)]
    own = {k: fresh(docs, k) for k in ("dk", "size", "no", "block", "upto", "nth", "shard", "slot", "old")}
    cols = {"id": id_col} | {k: own[k] for k in ("dk", "size", "no", "block", "upto", "nth")}
    keyed = docs.withColumns({own["dk"]: dk, own["size"]: size, own["old"]: F.col(f"`{old_col}`").cast("string")})
    nth = F.col(own["nth"])
    its = {c: fresh(docs, f"piece_{c}") for c in pieces.columns}
    piece, p = pieces.toDF(*its.values()), {c: F.col(v) for c, v in its.items()}
    whole = _placed(keyed, names, own["old"], cols).join(
        piece, (F.col(own["no"]) == p["old_no"]) & (F.col(own["block"]) == p["block"])
        & (nth >= p["from"]) & (nth < p["to"])) \
        .select(*[f"`{c}`" for c in docs.columns], p["shard"].alias(own["shard"]),
                (p["first"] + nth - p["from"]).alias(own["slot"]))
    shard, slot = own["shard"], own["slot"]
    path = scratch.path("shards")
    if affected and sizes:
        whole.filter(F.col(shard).isin(affected)).drop(old_col).sortWithinPartitions(shard, slot) \
            .write.partitionBy(shard).parquet(path)
        written = spark.read.parquet(path).withColumn(shard, F.col(shard).cast("int"))
    else:
        written = whole.filter(F.lit(False)).drop(old_col)
    if len(affected) < shards and sizes:
        written = written.unionByName(whole.filter(~F.col(shard).isin(affected)).drop(old_col))
    scratch.drop("slim", "inside")
    moved = int(flow.sum() - sum(flow[i, i] for i in range(min(flow.shape))))
    return {"flow": flow, "moved_bytes": moved, "affected": affected, "old": [r["old"] for r in sizes],
            "path": path, "rows": written, "shard_col": shard, "slot_col": slot}
