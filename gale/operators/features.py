"""Feature jobs: per-case cleaning chains, labels, averaging, alignment
(F1-F3, A1, J1-J3, J7, M2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gale.functions.labels import class_label, intensity_class
from gale.operators import clean, series

# --- Fixed values (reference feature layout) --------------------------------
DYNAMIC_PREDICTORS = ["SHRG", "D200", "Z850", "VMAX", "VMPI", "DELV", "RHMD", "NSST", "NOHC"]
IR_SLOTS = [6, 12, 54, 108]
IR_NAMES = ["GOES Tb", "s(GOES Tb)", "pct < -50C", "storm size"]
PC_SLOTS = [0, 6, 12, 18]
PC_NAMES = ["PC1", "PC2", "PC3", "PC4"]
IR_FALLBACK = {"IR00": ["IRM1", "IRM3"], "PC00": ["PCM1", "PCM3"]}
FEATURE_HOURS = list(range(-12, 25, 6))
# ---------------------------------------------------------------------------


def dynamic_features(df: DataFrame, case_keys: list[str], predictors: list[str], *,
                     hour_col: str = "TIME", hours: list[int] | None = None,
                     calc_pot: bool = True, interp: bool = True,
                     guard_col: str = "SHRG") -> DataFrame:
    """P1 -> P2 -> W5 (POT) -> W6 (DELV -12) -> P7 -> W9.

    The hour filter sits after W5/W6 on purpose: they read hours (-12, 0)
    that the filter may drop.
    """
    hours = hours if hours is not None else FEATURE_HOURS
    x = clean.select_predictors(df, case_keys + [hour_col], predictors)
    x = clean.sentinel_to_null(x, predictors)
    if calc_pot:
        x = series.potential_intensity(x, case_keys, hour_col)
    x = series.persistence(x, case_keys, hour_col)
    x = x.where(F.col(hour_col).isin(hours))
    if interp:
        cols = [c for c in x.columns if c not in case_keys and c != hour_col]
        x = series.interpolate_case(x, case_keys, hour_col, cols, guard_col=guard_col)
    return x


def ir_features(df: DataFrame, case_keys: list[str], *, hour_col: str = "TIME",
                hours: list[int] | None = None, ir_slots: list[int] = IR_SLOTS,
                ir_names: list[str] = IR_NAMES, pc_slots: list[int] = PC_SLOTS,
                pc_names: list[str] = PC_NAMES) -> DataFrame:
    """P1 -> P2 -> W8 (IR00 <- IRM1 <- IRM3, PC00 likewise) -> W7 -> P7."""
    hours = hours if hours is not None else FEATURE_HOURS
    raw = ["IR00", "IRM1", "IRM3", "PC00", "PCM1", "PCM3"]
    x = clean.select_predictors(df, case_keys + [hour_col], raw)
    x = clean.sentinel_to_null(x, raw)
    x = series.fill_fallback(x, IR_FALLBACK)
    x = series.slot_features(x, case_keys, hour_col, "IR00", ir_slots, ir_names)
    x = series.slot_features(x, case_keys, hour_col, "PC00", pc_slots, pc_names)
    return x.where(F.col(hour_col).isin(hours)).select(*case_keys, hour_col, *ir_names, *pc_names)


def join_dynamic_ir(dyn: DataFrame, ir: DataFrame, case_keys: list[str],
                    hour_col: str = "TIME") -> DataFrame:
    """Dynamic and IR features on (case, hour), by key (not position)."""
    return dyn.join(ir, case_keys + [hour_col], "left")


def case_features(df: DataFrame, case_keys: list[str], predictors: list[str], *,
                  hour_col: str = "TIME", hours: list[int] | None = None, carry: list[str] | None = None,
                  factors: dict[str, float] | None = None, mask: str = "SIMPLE_MASK", gate: bool = True,
                  basin_col: str | None = None, southern_basin: str = clean.SOUTHERN_BASIN,
                  nsst_basins: list[str] | None = None, ir_slots: list[int] = IR_SLOTS,
                  ir_names: list[str] = IR_NAMES, pc_slots: list[int] = PC_SLOTS, pc_names: list[str] = PC_NAMES,
                  calc_pot: bool = True, interp: bool = True, guard_col: str = "SHRG") -> DataFrame:
    """P2 -> P3 -> P5 -> P4 -> P10 -> P11, then F1 and F2 from that one frame.

    Sentinels are nulled before scaling; scaling and mask reach the IR and PC
    series as well as the predictors. With ``basin_col`` the southern basin's
    Z850 is negated and NSST / NOHC come from the column the basin reports.
    ``carry`` columns stay as they are. Everything per case (gate, POT, DELV -12,
    slots, interpolation) is a window over the case: one exchange.
    """
    hours = hours if hours is not None else FEATURE_HOURS
    raw_ir = ["IR00", "IRM1", "IRM3", "PC00", "PCM1", "PCM3"]
    keys = case_keys + [hour_col] + [c for c in (carry or []) + ([basin_col] if basin_col else []) if c not in case_keys]
    keys = list(dict.fromkeys(keys))
    ocean = [r for n, r in (("NSST", "RSST"), ("NOHC", "RHCN")) if basin_col and n in predictors and r in df.columns]
    values = list(dict.fromkeys([*predictors, *ocean, "DTL", *raw_ir]))
    x = clean.sentinel_to_null(df.select(*keys, *values), values)
    if factors:
        x = clean.apply_scale_factors(x, {k: v for k, v in factors.items() if k in values})
    if gate:
        x = clean.landfall_gate(x, case_keys, hour_col)
    x = clean.land_mask(x, keys, mask_type=mask)
    if basin_col:
        if "Z850" in predictors:
            x = clean.flip_hemisphere_sign(x, "Z850", basin_col, southern_basin)
        x = clean.harmonise_ocean_columns(x, basin_col, nsst_basins=nsst_basins)
    if calc_pot:
        x = series.potential_intensity(x, case_keys, hour_col)
    x = series.persistence(x, case_keys, hour_col)
    x = series.fill_fallback(x, IR_FALLBACK)
    x = series.slot_features(x, case_keys, hour_col, "IR00", ir_slots, ir_names)
    x = series.slot_features(x, case_keys, hour_col, "PC00", pc_slots, pc_names)
    dyn = [*predictors, *(["POT"] if calc_pot else []), "DELV -12"]
    x = x.where(F.col(hour_col).isin(hours)).select(*keys, *dyn, *ir_names, *pc_names)
    return series.interpolate_case(x, case_keys, hour_col, dyn, guard_col=guard_col) if interp else x


def average_hours(df: DataFrame, case_keys: list[str], feature_cols: list[str],
                  hour_col: str = "TIME", hours: tuple[int, ...] = (0, 6, 12, 18)) -> DataFrame:
    """A1: mean of each feature over the chosen hours per case (nulls skipped)."""
    return (df.where(F.col(hour_col).isin(list(hours)))
            .groupBy(*case_keys).agg(*[F.avg(c).alias(c) for c in feature_cols]))


def spread_hours_wide(df: DataFrame, case_keys: list[str], feature_cols: list[str],
                      hour_col: str = "TIME", hours: tuple[int, ...] = (0, 6, 12, 18)) -> DataFrame:
    """One column set per hour (``<c>_T0``, ``<c>_T6``...), outer-aligned
    on the case; a conditional aggregate with an explicit hour list."""
    aggs = [F.max(F.when(F.col(hour_col) == h, F.col(c))).alias(f"{c}_T{h}")
            for h in hours for c in feature_cols]
    return df.where(F.col(hour_col).isin(list(hours))).groupBy(*case_keys).agg(*aggs)


def attach_label(df: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of the case label onto every hour of the case."""
    return df.join(labels, keys, "left")


def align_features_labels(features: DataFrame, labels: DataFrame, keys: list[str],
                          label_cols: list[str]) -> DataFrame:
    """Features of labelled cases with complete features, with their
    label (features dropna(any) then inner join = both semi-joins)."""
    feats = features.na.drop(how="any", subset=[c for c in features.columns if c not in keys])
    return feats.join(labels.select(*keys, *label_cols).na.drop(how="all", subset=label_cols),
                      keys, "inner")


def case_labels(df: DataFrame, storm_keys: list[str], case_keys: list[str], time_col: str,
                hour_col: str = "TIME", vmax: str = "VMAX", *, threshold: float = 30,
                n_classes: int = 2, steps: int = 4, gap: str = "1 DAY",
                tiebreak: list[str] | None = None) -> DataFrame:
    """W1 + P20 at hour 0: one row per labelled case with ``d24_VMAX``,
    ``I_class`` and ``I_class label``."""
    t0 = df.where(F.col(hour_col) == 0).select(*dict.fromkeys(storm_keys + case_keys + [time_col, vmax]))
    d = series.change_over_rows(t0, storm_keys, time_col, [vmax], steps=steps, gap=gap,
                                tiebreak=tiebreak, carry=case_keys, prefix="d24_")
    cls = intensity_class(f"d24_{vmax}", n_classes, threshold)
    return d.select(*dict.fromkeys(storm_keys + case_keys + [time_col]), f"d24_{vmax}",
                    cls.alias("I_class"), class_label(cls, n_classes).alias("I_class label"))


def training_frame(df: DataFrame, storm_keys: list[str], case_keys: list[str], time_col: str,
                   feature_cols: list[str], *, hour_col: str = "TIME", threshold: float = 30,
                   n_classes: int = 2, steps: int = 4, gap: str = "1 DAY",
                   tiebreak: list[str] | None = None, average: bool = True,
                   hours: tuple[int, ...] = (0, 6, 12, 18)) -> DataFrame:
    """M2: label once (W1 + P20 at hour 0), average (A1) or spread (J7) the
    feature hours 0-18, then align features and labels (J2).

    Labels are computed before any year split, so 24-hour pairs across a
    split edge are kept (the split is by the case's own year, P22).
    """
    labels = case_labels(df, storm_keys, case_keys, time_col, hour_col, threshold=threshold,
                         n_classes=n_classes, steps=steps, gap=gap, tiebreak=tiebreak)
    keys = list(dict.fromkeys(storm_keys + case_keys + [time_col]))
    feats = (average_hours if average else spread_hours_wide)(df, keys, feature_cols, hour_col, hours)
    return align_features_labels(feats, labels, keys, ["d24_VMAX", "I_class", "I_class label"])
