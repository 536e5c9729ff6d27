"""Per-storm and per-case time-series operators.

Two kinds of grouping appear:

* a **storm** (series) may be arbitrarily long, so row offsets inside it are
  computed in chunks of time with a day of overlap, or, without a bound on the
  gap, with :func:`gale.operators.scan.range_shift` (range partitions and a
  small window of their border rows); no task ever holds a whole storm;
* a **case** holds one row per forecast hour, at most 23 rows by the data
  model (TIME is one of -12..120 step 6, unique per case), so windows and
  grouped aggregates partitioned by the case are bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gale.operators.scan import range_shift, with_position

# Grid for numbering rows of a storm series: one bucket per day of time
# (unix microseconds), so a long or hot series spreads over many tasks and
# the per-series offsets table has one row per day the series spans.
TIME_BUCKET = 86400 * 1e6
# Days of one storm in one window task (6-hourly data: 128 rows).
CHUNK_DAYS = 32


def _width(df: DataFrame, time_col: str) -> float | None:
    t = df.schema[time_col].dataType.simpleString()
    return TIME_BUCKET if t.startswith("timestamp") else None


def _interval(gap: str) -> Column:
    return F.expr(f"INTERVAL {gap}")


def _lead_within_a_day(df: DataFrame, keys: list[str], time_col: str, order: list[str], cols: list[str],
                       steps: int, suffix: str) -> DataFrame:
    """``lead(c, steps)`` for partners at most a day later; others may be null.

    A series is cut in chunks of ``CHUNK_DAYS`` days, and the rows of a chunk's
    first day are copied behind the previous chunk: every row sees all rows of
    its own and the next day. One window over (series, chunk): one shuffle,
    no join, and a long series spreads over many tasks.
    """
    day = F.datediff(F.to_date(time_col), F.lit("1970-01-01"))
    chunk = F.floor(day / CHUNK_DAYS)
    own = F.struct(chunk.alias("c"), F.lit(True).alias("own"))
    halo = F.struct((chunk - 1).alias("c"), F.lit(False).alias("own"))
    first = F.coalesce(F.pmod(day, F.lit(CHUNK_DAYS)) == 0, F.lit(False))
    x = df.withColumn("_at", F.explode(F.when(first, F.array(own, halo)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, F.col("_at.c")).orderBy(*[F.col(c).asc() for c in order])
    x = x.withColumns({c + suffix: F.lead(c, steps).over(w) for c in cols})
    return x.where("_at.own").drop("_at")


def change_over_rows(df: DataFrame, keys: list[str], time_col: str, value_cols: list[str], *,
                     steps: int = 4, gap: str | None = "1 DAY", tiebreak: list[str] | None = None,
                     carry: list[str] | None = None, prefix: str = "d24_",
                     drop_empty: bool = True) -> DataFrame:
    """Value ``steps`` rows later in the same series minus the value now.

    Rows are ordered by ``time_col`` (then ``tiebreak``) inside ``keys``; an
    empty ``keys`` orders the whole table as one series (the realtime form,
    W2). The change is kept only when the later row is exactly ``gap`` later
    (no guard when ``gap`` is None); with ``drop_empty`` rows whose changes
    are all null are dropped, otherwise every row is returned.
    """
    carry = [c for c in (carry or []) if c not in keys and c != time_col]
    order = [time_col] + list(tiebreak or [])
    base = df.select(*dict.fromkeys(keys + order + carry + value_cols))
    if keys and gap == "1 DAY" and _width(df, time_col):
        j = _lead_within_a_day(base, keys, time_col, order, [time_col] + value_cols, steps, "_later")
    else:
        j = range_shift(base, keys, order, [time_col] + value_cols, steps, suffix="_later")
    ok = F.lit(True) if gap is None else (F.col(time_col + "_later") == F.col(time_col) + _interval(gap))
    diffs = {prefix + c: F.when(ok, F.col(c + "_later") - F.col(c)) for c in value_cols}
    out = j.select(*dict.fromkeys(keys + order + carry), *[v.alias(k) for k, v in diffs.items()])
    if drop_empty:
        out = out.na.drop(how="all", subset=list(diffs))
    return out


def change_24h(df: DataFrame, storm_keys: list[str], time_col: str, value_cols: list[str], *,
               hour_col: str | None = None, init_hour: int = 0, **kw) -> DataFrame:
    """24-hour change over 6-hourly cases of one storm (shift of 4 cases).

    With ``hour_col`` only rows at forecast hour ``init_hour`` take part.
    """
    if hour_col is not None:
        df = df.where(F.col(hour_col) == init_hour).drop(hour_col)
    return change_over_rows(df, storm_keys, time_col, value_cols, steps=4, gap="1 DAY", **kw)


def change_24h_realtime(df: DataFrame, time_col: str, value_cols: list[str], *,
                        tiebreak: list[str], carry: list[str] | None = None,
                        prefix: str = "d24_") -> DataFrame:
    """The realtime form: all storms sorted by date as one series, so the
    row four later may belong to another storm; the 1-day guard still holds."""
    return change_over_rows(df, [], time_col, value_cols, steps=4, gap="1 DAY",
                            tiebreak=tiebreak, carry=carry, prefix=prefix, drop_empty=False)


def track_change(track: DataFrame, storm_keys: list[str], time_col: str,
                 value_cols: tuple[str, ...] = ("VMAX", "MSLP"), dt_hours: int = 24,
                 tiebreak: list[str] | None = None) -> DataFrame:
    """On a 6-hourly track, ``d{dt}_<c>`` = value dt/6 rows later minus
    now, null unless the later row is exactly one day later. Every track row
    is kept; the change columns are written onto it."""
    steps = dt_hours // 6
    carry = [c for c in track.columns if c not in storm_keys and c != time_col]
    return change_over_rows(track, storm_keys, time_col, list(value_cols), steps=steps,
                            gap="1 DAY", tiebreak=tiebreak, carry=carry,
                            prefix=f"d{dt_hours}_", drop_empty=False)


def change_reverse(df: DataFrame, keys: list[str], time_col: str, value_col: str = "VMAX", *,
                   steps: int = 4, floor: float = 40.0, tiebreak: list[str] | None = None,
                   out_col: str = "d_rev") -> DataFrame:
    """Value ``steps`` rows *earlier* minus the value now, null below
    ``floor``; rows without a value are dropped."""
    order = [time_col] + list(tiebreak or [])
    j = range_shift(df.select(*dict.fromkeys(keys + order + [value_col])), keys, order, [value_col], -steps, suffix="_earlier")
    d = F.col(value_col + "_earlier") - F.col(value_col)
    return (j.select(*dict.fromkeys(keys + order), F.when(d >= floor, d).alias(out_col))
            .where(F.col(out_col).isNotNull()))


def exact_time_change(df: DataFrame, storm_keys: list[str], time_col: str,
                      value_col: str = "VMAX", hours: int = 24, out_col: str = "d_V") -> DataFrame:
    """Change to the value exactly ``hours`` later in the same storm, by an
    equi-join on (storm, time + hours); attached back to every row (null when
    either end is missing). Missing 6-hour rows do not shift the pairing."""
    later = df.select(*storm_keys,
                      (F.col(time_col) - _interval(f"{hours} HOURS")).alias(time_col),
                      F.col(value_col).alias("_later"))
    return (df.join(later, storm_keys + [time_col], "left")
            .withColumn(out_col, F.col("_later") - F.col(value_col)).drop("_later"))


# ------------------------------------------------------------ per-case ops


def at_hour(case_keys: list[str], hour_col: str, hour: int, value_col: str) -> Column:
    """Value of ``value_col`` at forecast hour ``hour``, on every row of the
    case; null if the case has no such hour. A window over the case (at most
    one row per forecast hour), so that all columns of a case share one
    partitioning."""
    return F.max(F.when(F.col(hour_col) == hour, F.col(value_col))).over(Window.partitionBy(*case_keys))


def value_at_hour(df: DataFrame, case_keys: list[str], hour_col: str, hour: int,
                  value_col: str, out_col: str) -> DataFrame:
    """:func:`at_hour` as a column."""
    return df.withColumn(out_col, at_hour(case_keys, hour_col, hour, value_col))


def potential_intensity(df: DataFrame, case_keys: list[str], hour_col: str = "TIME",
                        vmpi: str = "VMPI", vmax: str = "VMAX", out_col: str = "POT") -> DataFrame:
    """POT = VMPI(t) - VMAX(hour 0) per case; null if no hour 0."""
    j = value_at_hour(df, case_keys, hour_col, 0, vmax, "_vmax0")
    return j.withColumn(out_col, F.col(vmpi) - F.col("_vmax0")).drop("_vmax0")


def persistence(df: DataFrame, case_keys: list[str], hour_col: str = "TIME",
                delv: str = "DELV", out_col: str = "DELV -12") -> DataFrame:
    """DELV at hour -12 on every row of the case."""
    return value_at_hour(df, case_keys, hour_col, -12, delv, out_col)


def slot_features(df: DataFrame, case_keys: list[str], hour_col: str, source_col: str,
                  slots: list[int], names: list[str]) -> DataFrame:
    """Features stored in fixed 'hour' slots of one series (IR00/PC00):
    the value at each slot becomes its own column on every row of the case."""
    return df.withColumns({n: at_hour(case_keys, hour_col, s, source_col) for s, n in zip(slots, names)})


def fill_fallback(df: DataFrame, chains: dict[str, list[str]]) -> DataFrame:
    """Row-wise fallback, e.g. IR00 <- IRM1 <- IRM3."""
    return df.withColumns({c: F.coalesce(*[F.col(x) for x in [c] + fb]) for c, fb in chains.items()})


def interpolate_case(df: DataFrame, case_keys: list[str], hour_col: str, cols: list[str], *,
                     guard_col: str = "SHRG", max_null_share: float = 0.5) -> DataFrame:
    """Linear interpolation by row position inside a case.

    Rows are numbered by ``hour_col`` inside the case. A null takes
    ``pv + (nv - pv) * (i - pi) / (ni - pi)`` from the last non-null before
    (pi, pv) and the first after (ni, nv); with nothing after it takes ``pv``;
    with nothing before it stays null. The case is left as it is when the
    nulls of ``guard_col`` are more than ``max_null_share`` of its rows.
    Windows are partitioned by case (bounded, see module doc).
    """
    w = Window.partitionBy(*case_keys).orderBy(hour_col)
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*case_keys)
    i = F.row_number().over(w)
    x = df.withColumn("_i", i)
    x = x.withColumn("_skip", F.sum(F.when(F.col(guard_col).isNull(), 1).otherwise(0)).over(whole)
                     > F.lit(max_null_share) * F.count(F.lit(1)).over(whole))
    exprs = {}
    for c in cols:
        pi = F.last(F.when(F.col(c).isNotNull(), F.col("_i")), ignorenulls=True).over(before)
        pv = F.last(F.col(c), ignorenulls=True).over(before)
        ni = F.first(F.when(F.col(c).isNotNull(), F.col("_i")), ignorenulls=True).over(after)
        nv = F.first(F.col(c), ignorenulls=True).over(after)
        filled = (F.when(F.col(c).isNotNull(), F.col(c))
                  .when(pv.isNull(), F.lit(None))
                  .when(nv.isNull(), pv)
                  .otherwise(pv + (nv - pv) * (F.col("_i") - pi) / (ni - pi)))
        exprs[c] = F.when(F.col("_skip"), F.col(c)).otherwise(filled)
    return x.withColumns(exprs).drop("_i", "_skip")


def number_cases(df: DataFrame, partition_cols: list[str], order_cols: list[str],
                 out_col: str = "CASE") -> DataFrame:
    """Running case number (1-based) in (partition, order) order,
    computed with distributed positions."""
    return with_position(df, partition_cols, order_cols, position_col=out_col,
                         bucket_width=_width(df, order_cols[0]))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
