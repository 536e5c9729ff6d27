"""Projections, filters and cleaning.

All are narrow (no shuffle) except where noted; each is a single ``select``
or ``filter`` so Catalyst pushes filters and column pruning into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gale.functions.numeric import round_half_even, safe_div
from gale.functions.names import NSST_BASINS

SENTINEL = 9999

# --- Fixed values -------------------------------------------------------------
LAND_DISTANCE_KM = 100           # SIMPLE_MASK: distance to land at or below this
SOUTHERN_BASIN = "SOUTHERN_HEM"  # basin whose vorticity sign is flipped
MAX_NAMED_STORM_NUMBER = 50      # cyclone numbers above this are invests
# ---------------------------------------------------------------------------


def select_predictors(df: DataFrame, keys: list[str], predictors: list[str]) -> DataFrame:
    """Keep keys and the chosen predictor columns."""
    return df.select(*dict.fromkeys(keys + predictors))


def sentinel_to_null(df: DataFrame, cols: list[str], sentinel: float = SENTINEL) -> DataFrame:
    """value == sentinel -> null, in one projection."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel).cast(df.schema[c].dataType))
                           for c in cols})


def apply_scale_factors(df: DataFrame, factors: dict[str, float], *,
                        drop: tuple[str, ...] = ("LON_AGE",)) -> DataFrame:
    """P3 (wide): coerce each predictor with a factor to double (bad text ->
    null) and divide by its factor; columns without a factor pass through.
    ``factors`` comes from the fixed factor dictionary (bounded, 138 keys)."""
    out = df.withColumns({c: F.col(c).try_cast("double") / F.lit(float(f))
                          for c, f in factors.items() if c in df.columns})
    return out.drop(*[c for c in drop if c in out.columns])


def apply_scale_factors_long(long_df: DataFrame, factor_table: DataFrame, *,
                             name_col: str = "name", value_col: str = "value") -> DataFrame:
    """P3/J8 (long): one row per (case, predictor, hour); factors joined by
    predictor name. Spark broadcasts the factor table if its size allows."""
    f = factor_table.select(F.col("name").alias(name_col), "factor")
    j = long_df.join(f, name_col, "left")
    v = F.col(value_col).try_cast("double")
    return j.withColumn(value_col, F.when(F.col("factor").isNotNull(), v / F.col("factor"))
                        .otherwise(v)).drop("factor")


def land_mask(df: DataFrame, keys: list[str], dtl_col: str = "DTL",
              distance: float = LAND_DISTANCE_KM, mask_type: str = "SIMPLE_MASK") -> DataFrame:
    """Null every non-key column of a row whose distance to land is at or
    below ``distance`` (null distance: kept)."""
    if mask_type == "no_MASK":
        return df
    if mask_type != "SIMPLE_MASK":
        raise ValueError(f"unknown mask type {mask_type}")
    near = F.col(dtl_col) <= distance
    return df.select(*[F.col(c) if c in keys else
                       F.when(near, F.lit(None).cast(df.schema[c].dataType))
                       .otherwise(F.col(c)).alias(c) for c in df.columns])


def land_mask_interval(df: DataFrame, case_keys: list[str], keys: list[str], hour_col: str = "TIME",
                       max_hour: int = 24, dtl_col: str = "DTL",
                       distance: float = LAND_DISTANCE_KM) -> DataFrame:
    """Mask the whole case when any hour 0..max_hour is within
    ``distance`` of land (case minimum joined back)."""
    lo = (df.where(F.col(hour_col).between(0, max_hour))
          .groupBy(*case_keys).agg(F.min(dtl_col).alias("_min_dtl")))
    j = df.join(lo, case_keys, "left")
    near = F.col("_min_dtl") <= distance
    return j.select(*[F.col(c) if c in keys else
                      F.when(near, F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                      for c in df.columns])


def landfall_gate(df: DataFrame, case_keys: list[str], hour_col: str = "TIME",
                  dtl_col: str = "DTL", distance: float = LAND_DISTANCE_KM) -> DataFrame:
    """P5: drop every row of a case whose distance to land at hour 0 is at or
    below ``distance`` (a window over the case, which later steps of a case
    chain share)."""
    near = F.max((F.col(hour_col) == 0) & (F.col(dtl_col) <= distance)).over(Window.partitionBy(*case_keys))
    return df.withColumn("_landed", near).where(~F.coalesce("_landed", F.lit(False))).drop("_landed")


def filter_years(df: DataFrame, years: list[int], date_col: str = "DATE_full",
                 year_col: str | None = None, keep: bool = True) -> DataFrame:
    """Rows whose year is (not) in ``years``. On a YEAR-partitioned table
    pass ``year_col`` so the filter prunes partitions; otherwise the years
    become half-open time ranges on ``date_col``, which parquet pushdown
    turns into row-group skipping (``year(x) IN ...`` would not push)."""
    if year_col:
        cond = F.col(year_col).isin(list(years))
    else:
        t = df.schema[date_col].dataType.simpleString()
        cast = "timestamp_ntz" if t == "timestamp_ntz" else ("date" if t == "date" else "timestamp")
        c = F.col(date_col)
        ranges = [(c >= F.lit(f"{y}-01-01").cast(cast)) & (c < F.lit(f"{y + 1}-01-01").cast(cast))
                  for y in sorted(set(years))]
        cond = ranges[0]
        for r in ranges[1:]:
            cond = cond | r
    return df.where(cond if keep else ~cond)


def filter_forecast_hours(df: DataFrame, hour_col: str = "TIME", start: int = -12,
                          stop: int = 24, step: int = 6, exclude: tuple[int, ...] = ()) -> DataFrame:
    """TIME in start..stop every ``step`` hours, minus ``exclude``."""
    hrs = [h for h in range(start, stop + 1, step) if h not in exclude]
    return df.where(F.col(hour_col).isin(hrs))


def cyclone_number(atcf_col: str | Column) -> Column:
    c = F.col(atcf_col) if isinstance(atcf_col, str) else atcf_col
    return F.substring(c, 3, 2).try_cast("int")


def filter_named_storms(df: DataFrame, number: Column, max_number: int = MAX_NAMED_STORM_NUMBER) -> DataFrame:
    """Cyclone number 1..max_number (drops invests 90+ and bad codes)."""
    return df.where(number.between(1, max_number))


def exclude_basin(df: DataFrame, basin: str = "IO", basin_col: str = "BASIN") -> DataFrame:
    """Drop one basin."""
    return df.where(F.col(basin_col) != basin)


def flip_hemisphere_sign(df: DataFrame, col: str = "Z850", basin_col: str = "BASIN",
                         basin: str = SOUTHERN_BASIN) -> DataFrame:
    """P10: negate ``col`` in the southern-hemisphere basin (once)."""
    return df.withColumn(col, F.when(F.col(basin_col) == basin, -F.col(col)).otherwise(F.col(col)))


def harmonise_ocean_columns(df: DataFrame, basin_col: str = "BASIN",
                            pairs: dict[str, str] | None = None,
                            nsst_basins: list[str] | None = None) -> DataFrame:
    """One ocean column per pair: the N-column in basins that report it,
    the R-column elsewhere; the R-column is dropped."""
    pairs = pairs or {"NSST": "RSST", "NOHC": "RHCN"}
    basins = nsst_basins or NSST_BASINS
    exprs = {}
    for n, r in pairs.items():
        if n in df.columns and r in df.columns:
            exprs[n] = F.when(F.col(basin_col).isin(basins), F.col(n)).otherwise(F.col(r))
        elif r in df.columns:
            exprs[n] = F.col(r)
    out = df.withColumns(exprs)
    return out.drop(*[r for r in pairs.values() if r in out.columns])


def storm_id(basin_code: Column, number: Column, year: Column) -> Column:
    """ATCF id = basin code + 2-digit number + 4-digit year."""
    return F.concat(basin_code, F.lpad(number.cast("string"), 2, "0"), year.cast("string"))


def strip_commas(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Remove commas from string columns."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.regexp_replace(F.col(c), ",", "") for c in cols})


def select_forecast_window(df: DataFrame, *, start: int = 0, stop: int = 24,
                           techniques: list[str] | None = None, change: float = 30,
                           start_col: str = "RIstartTAU", stop_col: str = "RIstopTAU",
                           tech_col: str = "Tech", change_col: str = "Intensity Change") -> DataFrame:
    """Forecasts for one window and intensity change."""
    cond = (F.col(start_col) == start) & (F.col(stop_col) == stop) & (F.col(change_col) == change)
    if techniques:
        cond = cond & F.col(tech_col).isin(techniques)
    return df.where(cond)


def drop_outlier_probability(df: DataFrame, prob_col: str, max_prob: float = 500) -> DataFrame:
    """Rows with a probability above ``max_prob`` are dropped whole."""
    return df.where(~(F.col(prob_col) > max_prob) | F.col(prob_col).isNull())


def filter_wind_radius(df: DataFrame, rad_col: str = "RAD", radius: int = 34) -> DataFrame:
    """One track row per fix (the 34-kt radius row)."""
    return df.where(F.col(rad_col) == radius)


def drop_null_rows(df: DataFrame, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    """Pandas ``dropna(how=...)``."""
    return df.na.drop(how=how, subset=subset)


def split_by_year(df: DataFrame, test_years: list[int], date_col: str = "DATE_full",
                  year_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) by year of the case."""
    y = F.col(year_col) if year_col else F.year(date_col)
    flagged = df.withColumn("is_TRAIN", (~y.isin(list(test_years))).cast("int"))
    return flagged.where("is_TRAIN = 1"), flagged.where("is_TRAIN = 0")


def bin_probability(p: str | Column, scale: float = 100.0) -> Column:
    """Percent, rounded to tens (ties to even), values at or below 5 go
    to the 5 bin."""
    c = F.col(p) if isinstance(p, str) else p
    b = round_half_even(c * F.lit(scale), -1)
    return F.when(b <= 5, F.lit(5.0)).otherwise(b)


def classify_at_threshold(score: str | Column, threshold: float | Column) -> Column:
    """Predicted class = score >= threshold."""
    s = F.col(score) if isinstance(score, str) else score
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (s >= t).cast("int")


def performance_columns(df: DataFrame, precision: str = "Precision", recall: str = "Recall",
                        threshold: str = "Thresholds") -> DataFrame:
    """P25: POD, FAR, success ratio, CSI, bias and the rounded threshold.
    CSI is 0 when POD or SR is 0; other 0/0 give null."""
    pod, sr = F.col(recall), F.col(precision)
    csi = F.when((pod == 0) | (sr == 0), F.lit(0.0)).otherwise(
        safe_div(F.lit(1.0), F.lit(1.0) / sr + F.lit(1.0) / pod - F.lit(1.0)))
    return df.withColumns({
        "POD": pod, "FAR": F.lit(1.0) - sr, "Success_Ratio": sr, "CSI": csi,
        "Bias": safe_div(pod, sr), "Thresh_Round": round_half_even(threshold, 2)})


def high_probability_cases(df: DataFrame, prob_col: str, change_col: str, *, min_prob: float = 70,
                           change: float = 40, basin_col: str | None = None,
                           basin: str | None = None) -> DataFrame:
    """Probability above ``min_prob`` for one intensity change (and basin)."""
    cond = (F.col(prob_col) > min_prob) & (F.col(change_col) == change)
    if basin_col and basin:
        cond = cond & (F.col(basin_col) == basin)
    return df.where(cond)


def drop_feature_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Remove bookkeeping / non-feature columns."""
    return df.drop(*cols)
