"""Exploration aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from gale.functions.numeric import count_if, safe_div
from gale.operators.scan import _join
from gale.session import materialize


def event_rate(df: DataFrame, group_cols: list[str], change_col: str,
               threshold: float = 30.0, out_col: str = "event_pct") -> DataFrame:
    """A4: 100 * count(change >= threshold) / count(change) per group.

    ``count`` skips nulls, as pandas does; groups with no change give null.
    """
    d = F.col(change_col)
    return df.groupBy(*group_cols).agg(
        (F.lit(100.0) * safe_div(count_if(d >= threshold), F.count(d))).alias(out_col),
        F.count(d).alias("n_changes"),
        count_if(d >= threshold).alias("n_events"))


def class_weights(labels: DataFrame, basin_col: str, class_col: str) -> DataFrame:
    """Cases per (basin, class) and over all basins ('ALL'), the share
    of each class within its basin (FRAC) and WEIGHT = 1 / FRAC."""
    from gale.operators.verify import with_all_scope
    c = labels.groupBy(basin_col, class_col).agg(F.count(F.lit(1)).alias("CASES"))
    c = with_all_scope(c, basin_col, ["CASES"], [class_col])
    total = F.sum("CASES").over(Window.partitionBy(basin_col))  # a row per class; a null basin is a basin
    out = c.withColumn("FRAC", safe_div(F.col("CASES"), total))
    return out.withColumn("WEIGHT", safe_div(F.lit(1.0), F.col("FRAC")))


def count_cases(df: DataFrame, cols: list[str], value_col: str | None = None) -> DataFrame:
    """A3: counts over a rollup of ``cols`` (subtotals have null keys);
    ``count(value_col)`` skips nulls as pandas does."""
    cnt = F.count(F.col(value_col)) if value_col else F.count(F.lit(1))
    return df.rollup(*cols).agg(cnt.alias("n"))


LOG_CELLS = 16     # first histogram: cells of each power of two
FINE_CELLS = 65536  # second histogram: equal parts of a first cell


def _magnitude_cell(v: Column) -> Column:
    """A cell number that never falls as ``v`` grows, whatever the data: a sixteenth
    of a power of two, mirrored for negative values."""
    size = F.floor(F.lit(float(LOG_CELLS)) * F.least(F.log2(F.abs(v)), F.lit(1100.0))).cast("int") + F.lit(1200 * LOG_CELLS)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def _wanted(upto: Column, before: Column, total: Column, qs: dict[str, float]) -> Column:
    """The (quantile, upper?, position) whose 1-based position lies in (before, upto]."""
    need = []
    for name, q in qs.items():
        h = (total - 1) * F.lit(float(q))
        for upper, p in ((False, F.floor(h)), (True, F.ceil(h))):
            need.append(F.struct(F.lit(name).alias("q"), F.lit(upper).alias("upper"), (p + 1).cast("bigint").alias("p"), h.alias("h")))
    return F.filter(F.array(*need), lambda w: (w["p"] > before) & (w["p"] <= upto))


def exact_quantiles(df: DataFrame, group_cols: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas' default), by
    selection instead of sorting.

    A histogram of magnitudes per group shows which cells hold a wanted rank; only
    their rows are kept and counted in finer cells, again only the cells with a
    wanted rank are kept, and their distinct values are counted. So only counts are
    shuffled, equal values collapse into one count, an outlier costs one cell, and no
    task sees a group. Null and NaN values are left out; a null group is a group;
    groups without values have no row."""
    v, g = F.col("_v"), list(group_cols)
    x = df.select(*g, F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan("_v")).withColumn("_c", _magnitude_cell(v))
    group, cell = Window.partitionBy(*g), Window.partitionBy(*g, "_c")

    def placed(counts: DataFrame, within: WindowSpec, order: str, before: Column) -> DataFrame:
        """Counted cells that hold a wanted rank, with how many rows of the group stand before them."""
        upto = before + F.sum("_n").over(within.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n")) \
            .withColumn("_want", _wanted(F.col("_upto"), F.col("_before"), F.col("_total"), qs)).where(F.size("_want") > 0)
    sums = [F.count(F.lit(1)).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi")]
    coarse = x.groupBy(*g, "_c").agg(*sums).withColumn("_total", F.sum("_n").over(group))
    coarse = materialize(placed(coarse, group, "_c", F.lit(0)).select(*g, "_c", "_lo", "_hi", "_before", "_total"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(FINE_CELLS))
    fine = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width), F.lit(FINE_CELLS - 1))).otherwise(F.lit(0)).cast("int")
    near = materialize(_join(x, coarse.withColumnRenamed("_before", "_base"), g + ["_c"], "inner").select(
        *g, "_c", "_v", "_base", "_total", fine.alias("_f")))
    cells = near.groupBy(*g, "_c", "_f", "_base", "_total").agg(F.count(F.lit(1)).alias("_n"))
    cells = materialize(placed(cells, cell, "_f", F.col("_base")).select(*g, "_c", "_f", "_before"))
    # one key column that is never null: join, counts and window share its partitioning
    key = F.struct(*g, "_c", "_f").alias("_k")
    last = near.select(key, *g, "_total", "_v").join(cells.select(key, F.col("_before").alias("_base")), "_k") \
        .groupBy("_k", *g, "_base", "_total", "_v").agg(F.count(F.lit(1)).alias("_n"))
    hits = placed(last, Window.partitionBy("_k"), "_v", F.col("_base")).select(*g, "_v", F.explode("_want").alias("w"))

    def of(name: str, upper: bool) -> Column:
        return F.max(F.when((F.col("w.q") == name) & (F.col("w.upper") == upper), v))
    frac = {name: F.max(F.when(F.col("w.q") == name, F.col("w.h") - F.floor("w.h"))) for name in qs}
    return hits.groupBy(*g).agg(*[(of(name, False) + (of(name, True) - of(name, False)) * frac[name]).alias(name) for name in qs])


def pearson_pairs(df: DataFrame, cols: list[str], min_abs: float = 0.0) -> DataFrame:
    """Pearson r of every pair (upper triangle) in one aggregate pass,
    unpivoted, kept when |r| >= min_abs. z-scoring first (the reference's
    step) does not change r."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    st = F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                      F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))
    out = row.select(st.alias("p")).select("p.*")
    return out.where(F.abs(F.col("r")) >= min_abs)


def histogram_fixed(df: DataFrame, group_cols: list[str], value: str, width: float = 10.0) -> DataFrame:
    """Counts per fixed-width bin (left edge = floor(x / width) * width)."""
    b = F.floor(F.col(value) / width) * width
    return (df.where(F.col(value).isNotNull()).groupBy(*group_cols, b.cast("double").alias("bin_left"))
            .agg(F.count(F.lit(1)).alias("n")))


def histogram_equal(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Numpy-style equal-width bins between the global min and max (the
    last bin includes the max). The range is one scalar aggregate."""
    x = df.where(F.col(value).isNotNull())
    lo, hi = x.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return x.select(F.lit(0).alias("bin"), F.lit(0.0).alias("bin_left"), F.lit(0).cast("bigint").alias("n")).limit(0)
    width = (hi - lo) / bins if hi > lo else 1.0
    idx = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (x.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_left", F.lit(lo) + F.col("bin") * F.lit(width)))


KDE_BINS = 1000   # bins of one bandwidth
KDE_REACH = 40.0  # bandwidths beyond which a kernel is 0 in a double


def gaussian_kde(df: DataFrame, group_cols: list[str], value: str, grid: tuple[float, float, int]) -> DataFrame:
    """Gaussian kernel density per group on a fixed grid (Scott's rule:
    h = sample std * n^(-1/5)).

    Rows are reduced to bins of h / KDE_BINS before anything is shuffled: count, mean
    and squared deviation of each bin, which is combined on the map side. A bin adds
    its count times the kernel at its mean, and the second-order term of its
    deviation; the first-order one is zero at the mean. What is left out is at most the
    largest third derivative of the kernel (1.39) times KDE_BINS^-3 / 6, below 2.4e-10
    of the kernel's height per row, and nothing for a bin of equal values. Values
    farther than KDE_REACH bandwidths from the grid add exactly 0 and are left out, so
    the bins of a group, and the rows shuffled, depend on the grid and not on the number
    of rows."""
    start, stop, num = grid
    step = (stop - start) / (num - 1)
    x = df.select(*group_cols, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    st = x.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"))
    st = st.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).where(F.col("_h") > 0)
    h, far = F.col("_h"), F.col("_h") * KDE_REACH
    near = _join(x, st.select(*group_cols, "_n", "_h"), list(group_cols), "inner") \
        .where((F.col("_x") >= F.lit(start) - far) & (F.col("_x") <= F.lit(stop) + far))
    # deviations from the bin's left edge: small numbers, no cancellation
    edge = F.col("_b") * h / KDE_BINS
    off = F.col("_x") - edge
    bins = near.withColumn("_b", F.floor(F.col("_x") / h * KDE_BINS)).groupBy(*group_cols, "_n", "_h", "_b").agg(
        F.count(F.lit(1)).alias("_c"), F.sum(off).alias("_s"), F.sum(off * off).alias("_ss"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    one = F.col("_lo") == F.col("_hi")
    mean = F.when(one, F.col("_lo")).otherwise(edge + F.col("_s") / F.col("_c"))
    dev = F.when(one, F.lit(0.0)).otherwise(F.greatest(F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_c"), F.lit(0.0)))
    bins = bins.withColumns({"_m": mean, "_d": dev / (h * h)})
    g = bins.select(*group_cols, "_n", "_h", "_c", "_m", "_d", F.explode(F.sequence(F.lit(0), F.lit(num - 1))).alias("_k"))
    gx = F.lit(start) + F.col("_k") * F.lit(step)
    z = (gx - F.col("_m")) / h
    k = F.exp(F.lit(-0.5) * z * z) * (F.col("_c") + F.col("_d") * (z * z - 1) / 2)
    dens = F.sum(k) / (F.first("_n") * F.first("_h") * F.lit((2 * 3.141592653589793) ** 0.5))
    return g.groupBy(*group_cols, gx.alias("x")).agg(dens.alias("density"))


def mean_by(df: DataFrame, group_cols: list[str], value: str, out_col: str | None = None) -> DataFrame:
    """Mean per group."""
    return df.groupBy(*group_cols).agg(F.avg(value).alias(out_col or f"mean_{value}"))


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct combinations of ``cols``."""
    return df.select(*cols).distinct()


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / sample std per column. The means and deviations are
    one scalar aggregate (two numbers per column), applied as literals."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                 *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(row[f"m_{c}"]), F.lit(row[f"s_{c}"]))
                           for c in cols})
