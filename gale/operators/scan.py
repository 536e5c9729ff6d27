"""Ordered scans inside groups that may be arbitrarily large.

A ``Window.partitionBy(group).orderBy(x)`` sends a whole group to one task.
When one group may hold a third of all rows (one storm, one model/basin/fold
of predictions) that task is the job. The functions here compute the same
running quantities in two levels instead:

1. every row gets a bucket: its cell on a grid of the first order column,
   either a fixed width chosen from the domain (``bucket_width``) or
   ``buckets`` equal cells between the group's min and max (one extra
   aggregate and join);
2. per (group, bucket) totals are aggregated (map-side partial aggregation),
   and a window over the at most ``buckets + 2`` rows of each group turns
   them into offsets;
3. the offsets are joined back on (group, bucket) and a window partitioned by
   (group, bucket) finishes the scan.

Every window therefore sees one bucket of one group, never the whole group.
The per-group min/max table is joined back on the group key; AQE broadcasts
it when its measured size is under the broadcast threshold and splits skewed
join partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BUCKETS = 128


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` treating null keys as equal (a null group is a
    group for the windows too); planned as an ordinary hash/sort-merge join."""
    if not keys:
        raise ValueError("keys required")
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def _numeric_key(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    col = F.col(c)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(dt, T.StringType):
        raise TypeError(f"order column {c!r} must be numeric or temporal for bucketing")
    return col.cast("double")


def _bucketed(df: DataFrame, group_cols: list[str], first: str, descending: bool,
              buckets: int, width: float | None = None) -> DataFrame:
    key = _numeric_key(df, first)
    if descending:
        key = -key
    if width:
        # Fixed grid chosen by the caller from the domain (e.g. 7 days of
        # storm time, 1/1024 of probability): no per-group statistics pass.
        b = F.when(key.isNull(), F.lit(None)).otherwise(F.floor(key / F.lit(float(width))))
        nb = F.lit(2 ** 62) if descending else F.lit(-(2 ** 62))
        return df.withColumn("_b", F.coalesce(b.cast("bigint"), nb))
    keyed = df.withColumn("_k", key)
    if group_cols:
        stats = keyed.groupBy(*group_cols).agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
        keyed = _join(keyed, stats, group_cols)
    else:
        lo, hi = keyed.agg(F.min("_k"), F.max("_k")).first()  # two scalars
        keyed = keyed.withColumns({"_lo": F.lit(lo).cast("double"), "_hi": F.lit(hi).cast("double")})
    width = F.col("_hi") - F.col("_lo")
    raw = F.when(width > 0, F.floor((F.col("_k") - F.col("_lo")) / width * F.lit(buckets)))\
        .otherwise(F.lit(0))
    # nulls sort first ascending, last descending (Spark's defaults)
    b = F.when(F.col("_k").isNull(), F.lit(buckets + 1 if descending else -1))\
        .otherwise(F.least(raw.cast("int"), F.lit(buckets - 1)))
    return keyed.withColumn("_b", b.cast("int")).drop("_k", "_lo", "_hi")


def running_totals(df: DataFrame, group_cols: list[str], order_cols: list[str],
                   value_cols: dict[str, Column] | None = None, *, descending: bool = False,
                   position_col: str | None = "_pos", buckets: int = DEFAULT_BUCKETS,
                   bucket_width: float | None = None) -> DataFrame:
    """Inclusive running sums in (group, order) order, distributed.

    ``value_cols`` maps an output name to the column whose running sum it
    holds; ``position_col`` (if given) receives the 1-based row position.
    Rows with equal order keys are numbered in an arbitrary but fixed order,
    so callers that need determinism pass a unique ordering.
    """
    values = dict(value_cols or {})
    if position_col:
        values[position_col] = F.lit(1).cast("bigint")
    tmp = {name: f"_v_{i}" for i, name in enumerate(values)}
    base = _bucketed(df, group_cols, order_cols[0], descending, buckets, bucket_width)
    base = base.withColumns({tmp[n]: c for n, c in values.items()})

    per_bucket = base.groupBy(*group_cols, "_b").agg(
        *[F.sum(tmp[n]).alias(tmp[n]) for n in values])
    wb = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*group_cols, "_b", *[
        F.coalesce(F.sum(tmp[n]).over(wb), F.lit(0)).alias(f"_o{tmp[n]}") for n in values])

    joined = _join(base, offsets, group_cols + ["_b"])
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    wr = Window.partitionBy(*group_cols, "_b").orderBy(*order)\
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumns({
        n: (F.sum(tmp[n]).over(wr) + F.col(f"_o{tmp[n]}")) for n in values})
    return out.drop("_b", *tmp.values(), *[f"_o{t}" for t in tmp.values()])


def with_position(df: DataFrame, group_cols: list[str], order_cols: list[str], *,
                  descending: bool = False, position_col: str = "_pos",
                  buckets: int = DEFAULT_BUCKETS, bucket_width: float | None = None) -> DataFrame:
    """1-based row number inside each group, without a whole-group window."""
    return running_totals(df, group_cols, order_cols, None, descending=descending,
                          position_col=position_col, buckets=buckets, bucket_width=bucket_width)


def segmented_scan(df: DataFrame, group_cols: list[str], order_cols: list[str], sums: dict[str, Column], *,
                   following: dict[str, str] | None = None, totals: dict[str, Column] | None = None,
                   products: dict[str, tuple[Column, str]] | None = None, descending: bool = False,
                   position_col: str = "pos", bucket_width: float) -> DataFrame:
    """Inclusive running sums, the next row's values and group totals in one scan.

    Rows are hashed once on (group, bucket); a window inside the bucket gives the
    local running sums, each bucket's totals and first row go through one small
    window per group (carry-in: what stands before the bucket; carry-out: the first
    row of the next one), and the carry rows are joined back on (group, bucket), which
    the rows are already partitioned by. So the rows are shuffled once.

    ``following`` maps an output name to the column whose value in the next row (in
    scan order) it holds, null in a group's last row. ``totals`` are aggregates of a
    whole group, ``products`` sums over a group of (factor, name of a running sum) that
    need the running sum itself, e.g. the area under a curve: both come on every row."""
    names = {**sums, position_col: F.lit(1).cast("bigint")}
    values = {n: f"_v{i}" for i, n in enumerate(names)}
    local = {n: f"_w{i}" for i, n in enumerate(names)}
    x = _bucketed(df, group_cols, order_cols[0], descending, DEFAULT_BUCKETS, bucket_width)
    # one key column that is never null (null groups are equal inside it), so that the join needs no other partitioning
    x = x.withColumns({"_g": F.struct(*group_cols), **{values[n]: c for n, c in names.items()}}).repartition("_g", "_b")
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    w = Window.partitionBy("_g", "_b").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    next_row = {o: F.lead(c).over(w).alias(o) for o, c in (following or {}).items()}
    x = x.select("*", *[F.sum(values[n]).over(upto).alias(local[n]) for n in names], *next_row.values(),
                 F.lead(F.lit(True)).over(w).isNull().alias("_last"))
    # every column stands in the one row kept of a bucket, so that both uses of the rows read the same exchange
    first = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate((following or {}).values())],
                     *[F.col(c).alias(f"e{i}") for i, c in enumerate([*df.columns, *values.values()])])
    per = x.groupBy("_g", "_b").agg(
        *[F.sum(values[n]).alias(values[n]) for n in names], F.max(F.when(F.col(local[position_col]) == 1, first)).alias("_first"),
        *[c.alias(n) for n, c in (totals or {}).items()],
        *[F.sum(f * F.col(local[n])).alias(f"_p{i}") for i, (f, n) in enumerate((products or {}).values())],
        *[F.sum(f).alias(f"_q{i}") for i, (f, _) in enumerate((products or {}).values())])
    g = Window.partitionBy("_g")
    before = g.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("_g", "_b", *[F.coalesce(F.sum(values[n]).over(before), F.lit(0)).alias(f"_o{i}") for i, n in enumerate(names)],
                       F.lead("_first").over(g.orderBy("_b")).alias("_next"), *(totals or {}),
                       *[F.col(f"_{k}{i}") for i in range(len(products or {})) for k in "pq"])
    merged = {n: F.sum(n).over(g) if not n.startswith("min_") else F.min(n).over(g) for n in (totals or {})}
    place = {n: i for i, n in enumerate(names)}
    merged |= {o: F.sum(F.col(f"_p{i}") + F.col(f"_o{place[n]}") * F.col(f"_q{i}")).over(g)
               for i, (o, (_, n)) in enumerate((products or {}).items())}
    carry = carry.select("_g", "_b", "_next", *[f"_o{i}" for i in range(len(names))], *[c.alias(n) for n, c in merged.items()])
    j = x.join(carry, ["_g", "_b"])
    j = j.withColumns({n: F.col(local[n]) + F.col(f"_o{i}") for i, n in enumerate(names)})
    j = j.withColumns({o: F.when(F.col("_last"), F.col("_next")[f"f{i}"]).otherwise(F.col(o))
                       for i, o in enumerate(following or {})})
    return j.drop("_g", "_b", "_last", "_next", *values.values(), *local.values(), *[f"_o{i}" for i in range(len(names))])


def range_shift(df: DataFrame, keys: list[str], order_cols: list[str], cols: list[str], k: int, *, suffix: str) -> DataFrame:
    """``lead(c, k)`` (k > 0) or ``lag(c, -k)`` (k < 0) inside each value of ``keys`` (or over
    the whole table: ``keys`` empty), for series of any length and rows at any density.

    The rows are range-partitioned on (keys, order), so equally many land in every
    partition however they crowd; a window inside the partition shifts them, and only
    the at most 2|k| border rows of each partition meet in one small window. (keys,
    order) should be unique. The partitioned rows are checkpointed: both uses of
    them must see the same borders."""
    from gale.session import materialize
    if k == 0:
        raise ValueError("k must be non-zero")
    sort = list(dict.fromkeys([*keys, *order_cols]))
    x = materialize(df.repartitionByRange(*sort).withColumn("_pid", F.spark_partition_id()))
    up = [F.col(c).asc() for c in sort]
    down = [F.col(c).desc() for c in sort]
    shift, m = (F.lead if k > 0 else F.lag), abs(k)
    partner = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)],
                       F.lit(1).alias("one"))
    inside = Window.partitionBy("_pid")
    x = x.withColumns({"_up": F.row_number().over(inside.orderBy(*up)), "_down": F.row_number().over(inside.orderBy(*down)),
                       "_to": shift(partner, m).over(inside.orderBy(*up))})
    edge = F.col("_down") <= m if k > 0 else F.col("_up") <= m  # partner, if any, in another partition
    border = x.where((F.col("_up") <= m) | (F.col("_down") <= m)).withColumn("_to", shift(partner, m).over(Window.orderBy(*up)))
    out = x.where(~edge).unionByName(border.where(edge))
    same = F.col("_to").isNotNull()
    for i, c in enumerate(keys):
        same = same & F.col("_to")[f"k{i}"].eqNullSafe(F.col(c))
    return out.withColumns({c + suffix: F.when(same, F.col("_to")[f"v{i}"]) for i, c in enumerate(cols)}) \
        .drop("_pid", "_up", "_down", "_to")


def with_lead(df: DataFrame, group_cols: list[str], order_cols: list[str], cols: list[str], k: int, *,
              suffix: str | None = None, buckets: int = DEFAULT_BUCKETS,
              bucket_width: float | None = None) -> DataFrame:
    """``lead(c, k)`` (k > 0) or ``lag(c, -k)`` (k < 0) inside each group in
    (group, order) order, without a whole-group window and without joining
    the full data on position.

    Rows are bucketed as in :func:`running_totals` and the shift is taken by
    a window over (group, bucket). Only rows whose partner lies in another
    bucket (at most |k| per bucket) are completed by an equi-join on
    (group, position) against the at most |k| first (lead) or last (lag)
    rows of every bucket: a partner |k| positions away that lies in another
    bucket always has fewer than |k| rows before (after) it in its own
    bucket. So the full data is shuffled once, for the window.
    """
    if k == 0:
        raise ValueError("k must be non-zero")
    suffix = suffix or (f"_lead{k}" if k > 0 else f"_lag{-k}")
    base = _bucketed(df, group_cols, order_cols[0], False, buckets, bucket_width)
    per_bucket = base.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    wb = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*group_cols, "_b", "_nb",
                                F.coalesce(F.sum("_nb").over(wb), F.lit(0)).alias("_off"))
    x = _join(base, offsets, group_cols + ["_b"])
    w = Window.partitionBy(*group_cols, "_b").orderBy(*[F.col(c).asc() for c in order_cols])
    shift = F.lead if k > 0 else F.lag
    m = abs(k)
    x = x.withColumns({"_rn": F.row_number().over(w),
                       "_in": shift(F.lit(1), m).over(w).isNotNull(),
                       **{c + suffix: shift(F.col(c), m).over(w) for c in cols}})
    x = x.withColumn("_pos", F.col("_rn") + F.col("_off"))
    inside = x.where(F.col("_in"))
    edge = x.where(~F.col("_in")).drop(*[c + suffix for c in cols])
    ends = x.where((F.col("_rn") <= m) if k > 0 else (F.col("_rn") > F.col("_nb") - m))
    partner = ends.select(*group_cols, (F.col("_pos") - F.lit(k)).alias("_pos"),
                          *[F.col(c).alias(c + suffix) for c in cols])
    edge = _join(edge, partner, group_cols + ["_pos"])
    helpers = ["_b", "_nb", "_off", "_rn", "_in", "_pos"]
    return inside.unionByName(edge.select(*inside.columns)).drop(*helpers)
