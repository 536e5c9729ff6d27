"""Exact k-nearest-neighbour join by recursively split cells (used by M5).

Method
  1. Rows with equal coordinates become one point that carries its k + 1 smallest
     keys, which is all any row can need of them.
  2. Points are split into cells, level by level, each cell of more than ``cap``
     points at the eighths of its widest dimension (at the middle, if the eighths
     do not part it). Splitting is a grouped aggregate per level, so no task holds a
     class; the tree of cells keeps the bounding box of every cell.
  3. In its own cell a point finds k + 1 neighbours; the distance of the last one
     bounds the search. (A cell with fewer points starts from the farthest corner
     of its parent's box.)
  4. Border pass: (point, cell) states descend the tree from the root, and follow a
     child only if its box is no farther than the bound. Visitors of a cell come
     in blocks, so one task compares a bounded number of visitors with a cell.
  5. The lists are merged per point; a row's neighbours are its point's list
     without the row itself.

Boxes and distances add the same squares in the same order, so rounding never puts
a point nearer than its box and the pruning is exact. Distances are computed in
numpy, on Arrow groups of bounded size; everything else is DataFrame code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gale.session import materialize

PARTS = 8        # children of a split cell
VISITORS = 4096  # visiting points compared with a cell in one task


def _points(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(x, pid, ids): distinct coordinates, their smallest key, their k + 1 smallest keys."""
    order = Window.partitionBy("x").orderBy("id")
    first = rows.select(F.col(key).alias("id"), "x").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    return first.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("pid", F.col("ids")[0])


def _square(gap: Column) -> Column:
    return gap * gap


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _box_distance(x: str, low: str, high: str, d: int) -> Column:
    """Squared distance of ``x`` to the box, 0 inside."""
    return _sum([_square(F.greatest(F.col(low)[i] - F.col(x)[i], F.col(x)[i] - F.col(high)[i], F.lit(0.0))) for i in range(d)])


def _corner_distance(x: str, low: str, high: str, d: int) -> Column:
    """Squared distance of ``x`` to the farthest corner of the box."""
    return _sum([_square(F.greatest(F.abs(F.col(low)[i] - F.col(x)[i]), F.abs(F.col(x)[i] - F.col(high)[i]))) for i in range(d)])


def split_cells(points: DataFrame, d: int, cap: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(points with cell and first bound, tree). The tree has a row per cell: node, parent,
    depth, leaf, low, high (its bounding box)."""
    x = [F.col("x")[i] for i in range(d)]
    eighths = [j / PARTS for j in range(1, PARTS)]
    open_ = points.withColumns({"node": F.lit("0"), "parent": F.lit(""), "bound": F.lit(float("inf"))})
    done, tree, depth = [], [], 0
    while True:
        open_ = materialize(open_)
        stats = open_.groupBy("node", "parent").agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.min(c) for c in x]).alias("low"), F.array(*[F.max(c) for c in x]).alias("high"),
            F.array(*[F.percentile_approx(c, eighths, 200) for c in x]).alias("cuts"))
        width = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.struct((F.col("high")[i] - F.col("low")[i]).alias("w"), (-i).alias("i")))
        stats = materialize(stats.withColumn("dim", -F.array_max(width)["i"]).withColumn("leaf", F.col("n") <= cap)
                            .withColumn("cut", F.expr("array_distinct(filter(cuts[dim], c -> c > low[dim]))"))
                            .withColumn("cut", F.expr("IF(size(cut) > 0, cut, array(IF(low[dim] + (high[dim] - low[dim]) / 2 > low[dim], "
                                                      "low[dim] + (high[dim] - low[dim]) / 2, high[dim])))")))
        tree.append(stats.select("node", "parent", F.lit(depth).alias("depth"), "leaf", "low", "high"))
        placed = open_.join(stats.select("node", "n", "leaf", "low", "high", "dim", "cut"), "node")
        done.append(placed.where("leaf").select("pid", "ids", "x", F.col("node").alias("cell"),
                                                F.when(F.col("n") > k, float("inf")).otherwise(F.col("bound")).alias("bound")))
        if stats.where("NOT leaf").isEmpty():
            break
        # a split cell has more than k points: its farthest corner bounds its points' k + 1 neighbours
        child = F.concat_ws(".", "node", F.expr("CAST(size(filter(cut, c -> c <= x[dim])) AS string)"))
        open_ = placed.where("NOT leaf").select("pid", "ids", "x", child.alias("node"), F.col("node").alias("parent"),
                                                _corner_distance("x", "low", "high", d).alias("bound"))
        depth += 1
    cells, cuts = done[0], tree[0]
    for c, t in zip(done[1:], tree[1:]):
        cells, cuts = cells.unionByName(c), cuts.unionByName(t)
    return materialize(cells), cuts


def _nearest(x: np.ndarray, bound: np.ndarray, cell: np.ndarray, ids: list[list], k: int):
    """Per row of ``x`` its k + 1 nearest (squared distance, id) in the cell, none beyond ``bound``."""
    for lo in range(0, len(x), 512):
        part = x[lo:lo + 512]
        dist = np.zeros((len(part), len(cell)))
        for i in range(cell.shape[1]):
            gap = part[:, i, None] - cell[None, :, i]
            dist += gap * gap
        last = np.partition(dist, k, axis=1)[:, k] if len(cell) > k + 1 else np.full(len(part), np.inf)
        last = np.minimum(last, bound[lo:lo + 512])
        for r, limit in enumerate(last):
            near = np.flatnonzero(dist[r] <= limit)
            yield sorted((float(dist[r, j]), i) for j in near for i in ids[j])[:k + 1]


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten())
    return flat.reshape(len(column), -1)


_LISTS = "list array<struct<d: double, id: {kind}>>"


def _lists(rows: list[list[tuple]], kind: pa.DataType):
    return pa.array([[{"d": d, "id": i} for d, i in r] for r in rows], pa.list_(pa.struct([("d", pa.float64()), ("id", kind)])))


def _own_cell(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, x, bound = table.column("ids").to_pylist(), _matrix(table.column("x")), np.asarray(table.column("bound"))
        found = list(_nearest(x, bound, x, ids, k))
        last = [min(b, r[k][0]) if len(r) > k else b for r, b in zip(found, bound.tolist())]
        return pa.table({"pid": table.column("pid"), "x": table.column("x"), "cell": table.column("cell"), "bound": pa.array(last, pa.float64()),
                         "list": _lists(found, table.schema.field("pid").type)})
    return run


def _visited_cell(k: int):
    def run(visitors: pa.Table, cell: pa.Table) -> pa.Table:
        kind = visitors.schema.field("pid").type
        if not len(visitors) or not len(cell):
            return pa.table({"pid": pa.array([], kind), "list": _lists([], kind)})
        found = _nearest(_matrix(visitors.column("x")), np.asarray(visitors.column("bound")), _matrix(cell.column("x")),
                         cell.column("ids").to_pylist(), k)
        return pa.table({"pid": visitors.column("pid"), "list": _lists(list(found), kind)})
    return run


def nearest_neighbours(rows: DataFrame, key: str, features: list[str], k: int = 5, cap: int = 2048) -> DataFrame:
    """(``key``, rank 1..k, neighbour, distance2): every row's k nearest other rows by
    squared Euclidean distance; ties go to the smaller key. ``key`` must be unique;
    rows with a null or NaN feature take no part; fewer than k + 1 rows: all the
    others; an empty table gives an empty result. ``cap`` is at least k + 1."""
    cap, d = max(cap, k + 1), len(features)
    value = [F.col(f"`{f}`").cast("double") for f in features]
    whole = ~F.exists(F.array(*value), lambda v: v.isNull() | F.isnan(v))
    vectors = rows.where(whole).select(key, F.array(*[v + F.lit(0.0) for v in value]).alias("x"))  # -0.0 is 0.0
    kind = vectors.schema[key].dataType.simpleString()
    points = materialize(_points(vectors, key, k))
    cells, tree = split_cells(points, d, cap, k)
    lists = _LISTS.format(kind=kind)
    own = materialize(cells.groupBy("cell").applyInArrow(
        _own_cell(k), f"pid {kind}, x array<double>, cell string, bound double, {lists}"))
    # border pass: who may have a neighbour in which other cell
    state, arrived = own.select("pid", "x", "bound", "cell", F.lit("0").alias("at")), []
    root = tree.where("depth = 0").select("leaf").first()
    depth = 0
    while root is not None and not root["leaf"]:
        depth += 1
        level = tree.where(F.col("depth") == depth)
        if level.isEmpty():
            break
        hit = materialize(state.join(level, F.col("at") == F.col("parent"))
                          .where(_box_distance("x", "low", "high", d) <= F.col("bound"))
                          .select("pid", "x", "bound", "cell", F.col("node").alias("at"), "leaf"))
        arrived.append(hit.where("leaf AND at <> cell").select("pid", "x", "bound", F.col("at").alias("cell")))
        state = hit.where("NOT leaf").drop("leaf")
    found = own.select("pid", "list")
    if arrived:
        visits = arrived[0]
        for a in arrived[1:]:
            visits = visits.unionByName(a)
        blocks = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("blocks"))
        visits = visits.join(blocks, "cell").withColumn("block", F.expr("pmod(xxhash64(pid), blocks)").cast("int"))
        hosts = cells.join(blocks, "cell").select("cell", "x", "ids", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        found = found.unionByName(visits.groupBy("cell", "block").cogroup(hosts.groupBy("cell", "block"))
                                  .applyInArrow(_visited_cell(k), f"pid {kind}, {lists}"))
    one = found.select("pid", F.explode("list").alias("e")).select("pid", "e.d", "e.id")
    best = one.withColumn("r", F.row_number().over(Window.partitionBy("pid").orderBy("d", "id"))).where(F.col("r") <= k + 1)
    merged = best.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("list"))
    mine = vectors.join(points.select("x", "pid"), "x").select(key, "pid").join(merged, "pid")
    others = F.slice(F.filter("list", lambda e: e["id"] != F.col(key)), 1, k)
    return mine.select(key, F.posexplode(others).alias("p", "e")) \
        .select(key, (F.col("p") + 1).alias("rank"), F.col("e.id").alias("neighbour"), F.col("e.d").alias("distance2"))
