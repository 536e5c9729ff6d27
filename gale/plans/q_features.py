"""Queries over cases and forecast hours: cleaning (P1-P11, P19, P22),
per-case features (W5-W9, F1-F3), labels and the training frame (A1, J1-J3,
J7, M2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gale.operators import clean, features, series
from gale.plans import views as V
from gale.plans.catalog import R, register
from gale.session import materialize

SENT = ["SHRG", "IR00", "IRM1", "PC00", "PCM1"]
CASE = ["case_id"]
# Stand-in slots: the hours view spans -12..24, so the IR slots are taken
# inside that range (the reference layout is the default in features.py).
IR_SLOTS = [6, 12, 18, 24]
IR_NAMES = ["IR_tb", "IR_sd", "IR_pct", "IR_size"]
PC_SLOTS = [0, 6, 12, 18]
PC_NAMES = ["PC1", "PC2", "PC3", "PC4"]
DYN = ["SHRG", "D200", "Z850", "VMAX", "VMPI", "DELV", "RHMD"]
FORE = [0, 6, 12, 18, 24]


def _q(c: str) -> str:
    return f'"{c}"'


def interp_sql(src: str, cols: list[str], keys: str = "case_id", guard: str = "SHRG") -> str:
    """DuckDB twin of W9 over CTE ``src``; yields CTE text for ``interp``."""
    wins = []
    for k, c in enumerate(cols):
        q = _q(c)
        wins.append(f"""last_value(CASE WHEN {q} IS NOT NULL THEN i END IGNORE NULLS) OVER wb AS pi{k},
          last_value({q} IGNORE NULLS) OVER wb AS pv{k},
          first_value(CASE WHEN {q} IS NOT NULL THEN i END IGNORE NULLS) OVER wa AS ni{k},
          first_value({q} IGNORE NULLS) OVER wa AS nv{k}""")
    outs = [f"""CASE WHEN nn > 0.5 * cnt OR {_q(c)} IS NOT NULL THEN {_q(c)} WHEN pv{k} IS NULL THEN NULL
             WHEN nv{k} IS NULL THEN pv{k} ELSE pv{k} + (nv{k} - pv{k}) * (i - pi{k}) / (ni{k} - pi{k}) END AS {_q(c)}"""
            for k, c in enumerate(cols)]
    return f"""
_n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY TIME) AS i,
       count(*) FILTER (WHERE {guard} IS NULL) OVER (PARTITION BY {keys}) AS nn,
       count(*) OVER (PARTITION BY {keys}) AS cnt FROM {src}),
_g AS (SELECT *, {', '.join(wins)} FROM _n
       WINDOW wb AS (PARTITION BY {keys} ORDER BY TIME ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              wa AS (PARTITION BY {keys} ORDER BY TIME ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
interp AS (SELECT * EXCLUDE ({', '.join(_q(c) for c in cols)}), {', '.join(outs)} FROM _g)
"""


def _nulls(cols, src_alias=""):
    return ", ".join(f"nullif({src_alias}{c}, 9999) AS {c}" for c in cols)


# --------------------------------------------------------------- P1, P2, P7


@register("select_predictors", f"""
SELECT case_id, TIME, {R('VMAX')} AS VMAX, {R('SHRG')} AS SHRG, {R('DTL')} AS DTL FROM hours
""", ("hours",))
def q_select_predictors(spark, sf_dir):
    """Keep the keys and the chosen predictors."""
    return clean.select_predictors(V.hours(spark, sf_dir), ["case_id", "TIME"], ["VMAX", "SHRG", "DTL"])


@register("sentinel_to_null", f"""
SELECT case_id, TIME, {R('VMAX')} AS VMAX, {', '.join(f"{R(f'nullif({c}, 9999)')} AS {c}" for c in SENT)} FROM hours
""", ("hours",))
def q_sentinel_to_null(spark, sf_dir):
    """9999 -> null in every sentinel-bearing column."""
    h = V.hours(spark, sf_dir).select("case_id", "TIME", "VMAX", *SENT)
    return clean.sentinel_to_null(h, SENT)


@register("filter_forecast_hours", f"""
SELECT case_id, TIME, {R('VMAX')} AS VMAX FROM hours WHERE TIME IN (-12, -6, 0, 6, 12, 18)
""", ("hours",))
def q_filter_forecast_hours(spark, sf_dir):
    """Hours -12..24 every 6 h with hour 24 dropped (feature hours)."""
    h = V.hours(spark, sf_dir).select("case_id", "TIME", "VMAX")
    return clean.filter_forecast_hours(h, "TIME", -12, 24, 6, exclude=(24,))


@register("drop_null_rows", f"""
SELECT case_id, TIME, {R('s')} AS SHRG, {R('i')} AS IR00 FROM
  (SELECT case_id, TIME, nullif(SHRG, 9999) AS s, nullif(IR00, 9999) AS i FROM hours)
WHERE s IS NOT NULL AND i IS NOT NULL
""", ("hours",))
def q_drop_null_rows(spark, sf_dir):
    """dropna(how='any') over the cleaned columns."""
    h = clean.sentinel_to_null(V.hours(spark, sf_dir).select("case_id", "TIME", "SHRG", "IR00"),
                               ["SHRG", "IR00"])
    return clean.drop_null_rows(h, "any", ["SHRG", "IR00"])


# ----------------------------------------------------------------- P4, P5


@register("land_mask", f"""
SELECT case_id, TIME,
  CASE WHEN DTL <= 100 THEN NULL ELSE {R('DTL')} END AS DTL,
  CASE WHEN DTL <= 100 THEN NULL ELSE {R('VMAX')} END AS VMAX,
  CASE WHEN DTL <= 100 THEN NULL ELSE {R('SHRG')} END AS SHRG
FROM hours
""", ("hours",))
def q_land_mask(spark, sf_dir):
    """SIMPLE_MASK: null non-key columns of rows within 100 km of land."""
    h = V.hours(spark, sf_dir).select("case_id", "TIME", "DTL", "VMAX", "SHRG")
    return clean.land_mask(h, ["case_id", "TIME"])


@register("land_mask_interval", f"""
WITH m AS (SELECT case_id, min(DTL) AS md FROM hours WHERE TIME BETWEEN 0 AND 24 GROUP BY case_id)
SELECT h.case_id, h.TIME,
  CASE WHEN m.md <= 100 THEN NULL ELSE {R('h.DTL')} END AS DTL,
  CASE WHEN m.md <= 100 THEN NULL ELSE {R('h.VMAX')} END AS VMAX
FROM hours h LEFT JOIN m ON h.case_id = m.case_id
""", ("hours",))
def q_land_mask_interval(spark, sf_dir):
    """Mask the whole case when any hour 0..24 is within 100 km of land."""
    h = V.hours(spark, sf_dir).select("case_id", "TIME", "DTL", "VMAX")
    return clean.land_mask_interval(h, CASE, ["case_id", "TIME"])


@register("landfall_gate", f"""
SELECT case_id, TIME, {R('DTL')} AS DTL FROM hours
WHERE case_id NOT IN (SELECT case_id FROM hours WHERE TIME = 0 AND DTL <= 100)
""", ("hours",))
def q_landfall_gate(spark, sf_dir):
    """P5: drop cases within 100 km of land at hour 0 (anti join)."""
    h = V.hours(spark, sf_dir).select("case_id", "TIME", "DTL")
    return clean.landfall_gate(h, CASE)


# -------------------------------------------------------------- W5 - W9


@register("potential_intensity", f"""
WITH v0 AS (SELECT case_id, max(VMAX) AS v0 FROM hours WHERE TIME = 0 GROUP BY case_id)
SELECT h.case_id, h.TIME, {R('h.VMPI - v0.v0')} AS POT FROM hours h LEFT JOIN v0 ON h.case_id = v0.case_id
""", ("hours",))
def q_potential_intensity(spark, sf_dir):
    """POT = VMPI(t) - VMAX(hour 0) per case."""
    h = V.hours(spark, sf_dir).select("case_id", "TIME", "VMPI", "VMAX")
    return series.potential_intensity(h, CASE).select("case_id", "TIME", "POT")


@register("persistence", f"""
WITH d AS (SELECT case_id, max(DELV) AS d FROM hours WHERE TIME = -12 GROUP BY case_id)
SELECT h.case_id, h.TIME, {R('d.d')} AS "DELV -12" FROM hours h LEFT JOIN d ON h.case_id = d.case_id
""", ("hours",))
def q_persistence(spark, sf_dir):
    """DELV at hour -12 on every row of the case."""
    h = V.hours(spark, sf_dir).select("case_id", "TIME", "DELV")
    return series.persistence(h, CASE).select("case_id", "TIME", "DELV -12")


@register("fill_ir_fallback", f"""
SELECT case_id, TIME,
  {R('coalesce(nullif(IR00, 9999), nullif(IRM1, 9999), IRM3)')} AS IR00,
  {R('coalesce(nullif(PC00, 9999), nullif(PCM1, 9999), PCM3)')} AS PC00
FROM hours
""", ("hours",))
def q_fill_ir_fallback(spark, sf_dir):
    """IR00 <- IRM1 <- IRM3 and PC00 <- PCM1 <- PCM3 after P2."""
    raw = ["IR00", "IRM1", "IRM3", "PC00", "PCM1", "PCM3"]
    h = clean.sentinel_to_null(V.hours(spark, sf_dir).select("case_id", "TIME", *raw), raw)
    return series.fill_fallback(h, {"IR00": ["IRM1", "IRM3"], "PC00": ["PCM1", "PCM3"]})\
        .select("case_id", "TIME", "IR00", "PC00")


@register("ir_slot_features", f"""
WITH s AS (SELECT case_id,
  max(CASE WHEN TIME = 6 THEN nullif(IR00, 9999) END) AS IR_tb, max(CASE WHEN TIME = 12 THEN nullif(IR00, 9999) END) AS IR_sd,
  max(CASE WHEN TIME = 18 THEN nullif(IR00, 9999) END) AS IR_pct, max(CASE WHEN TIME = 24 THEN nullif(IR00, 9999) END) AS IR_size
  FROM hours GROUP BY case_id)
SELECT h.case_id, h.TIME, {R('IR_tb')} AS IR_tb, {R('IR_sd')} AS IR_sd, {R('IR_pct')} AS IR_pct, {R('IR_size')} AS IR_size
FROM hours h LEFT JOIN s ON h.case_id = s.case_id
""", ("hours",))
def q_ir_slot_features(spark, sf_dir):
    """Values stored at fixed hour slots become case-wide features."""
    h = clean.sentinel_to_null(V.hours(spark, sf_dir).select("case_id", "TIME", "IR00"), ["IR00"])
    return series.slot_features(h, CASE, "TIME", "IR00", IR_SLOTS, IR_NAMES).drop("IR00")


@register("interpolate_case", "WITH x AS (SELECT case_id, TIME, nullif(SHRG, 9999) AS SHRG, nullif(PC00, 9999) AS PC00 FROM hours),"
          + interp_sql("x", ["SHRG", "PC00"]) + f"""
SELECT case_id, TIME, {R('SHRG')} AS SHRG, {R('PC00')} AS PC00 FROM interp
""", ("hours",))
def q_interpolate_case(spark, sf_dir):
    """Position-linear interpolation inside each case, SHRG null guard."""
    h = clean.sentinel_to_null(V.hours(spark, sf_dir).select("case_id", "TIME", "SHRG", "PC00"),
                               ["SHRG", "PC00"])
    return series.interpolate_case(h, CASE, "TIME", ["SHRG", "PC00"])


# ----------------------------------------------------------------- F1 - F3

_DYN_COLS = DYN + ["POT", "DELV -12"]
_F1_SQL = f"""
x0 AS (SELECT case_id, TIME, {_nulls(DYN)} FROM hours),
v0 AS (SELECT case_id, max(VMAX) AS v0 FROM x0 WHERE TIME = 0 GROUP BY case_id),
dm AS (SELECT case_id, max(DELV) AS dm FROM x0 WHERE TIME = -12 GROUP BY case_id),
x AS (SELECT x0.*, x0.VMPI - v0.v0 AS POT, dm.dm AS "DELV -12"
      FROM x0 LEFT JOIN v0 ON x0.case_id = v0.case_id LEFT JOIN dm ON x0.case_id = dm.case_id
      WHERE TIME IN ({', '.join(map(str, FORE))})),
{interp_sql('x', _DYN_COLS)}
"""


@register("dynamic_features", f"""
WITH {_F1_SQL}
SELECT case_id, TIME, {', '.join(f'{R(_q(c))} AS {_q(c)}' for c in _DYN_COLS)} FROM interp
""", ("hours",))
def q_dynamic_features(spark, sf_dir):
    """P1 -> P2 -> W5 -> W6 -> P7 -> W9 in one chain over all cases."""
    return features.dynamic_features(V.hours(spark, sf_dir, materialized=True), CASE, DYN, hours=FORE)


_F2_SQL = f"""
f0 AS (SELECT case_id, TIME,
         coalesce(nullif(IR00, 9999), nullif(IRM1, 9999), IRM3) AS IR00,
         coalesce(nullif(PC00, 9999), nullif(PCM1, 9999), PCM3) AS PC00 FROM hours),
fs AS (SELECT case_id,
  {', '.join(f'max(CASE WHEN TIME = {s} THEN IR00 END) AS {n}' for s, n in zip(IR_SLOTS, IR_NAMES))},
  {', '.join(f'max(CASE WHEN TIME = {s} THEN PC00 END) AS {n}' for s, n in zip(PC_SLOTS, PC_NAMES))}
  FROM f0 GROUP BY case_id),
f2 AS (SELECT f0.case_id, f0.TIME, fs.* EXCLUDE (case_id) FROM f0 LEFT JOIN fs ON f0.case_id = fs.case_id
       WHERE f0.TIME IN ({', '.join(map(str, FORE))}))
"""
_IR_COLS = IR_NAMES + PC_NAMES


@register("ir_features", f"""
WITH {_F2_SQL}
SELECT case_id, TIME, {', '.join(f'{R(c)} AS {c}' for c in _IR_COLS)} FROM f2
""", ("hours",))
def q_ir_features(spark, sf_dir):
    """P1 -> P2 -> W8 -> W7 -> P7 over all cases."""
    return features.ir_features(V.hours(spark, sf_dir), CASE, hours=FORE, ir_slots=IR_SLOTS,
                                ir_names=IR_NAMES, pc_slots=PC_SLOTS, pc_names=PC_NAMES)


@register("join_dynamic_ir", f"""
WITH {_F1_SQL}, {_F2_SQL}
SELECT i.case_id, i.TIME, {', '.join(f'{R("i." + _q(c))} AS {_q(c)}' for c in _DYN_COLS)},
       {', '.join(f'{R("f2." + c)} AS {c}' for c in _IR_COLS)}
FROM interp i LEFT JOIN f2 ON i.case_id = f2.case_id AND i.TIME = f2.TIME
""", ("hours",))
def q_join_dynamic_ir(spark, sf_dir):
    """Dynamic (F1) and IR (F2) features joined on (case, hour)."""
    h = V.hours(spark, sf_dir, materialized=True)
    dyn = features.dynamic_features(h, CASE, DYN, hours=FORE)
    ir = features.ir_features(h, CASE, hours=FORE, ir_slots=IR_SLOTS, ir_names=IR_NAMES,
                              pc_slots=PC_SLOTS, pc_names=PC_NAMES)
    return features.join_dynamic_ir(dyn, ir, CASE)


# stand-in divisors, basins and ocean columns of the case chain
F3_DYN = DYN + ["NSST"]
_F3_COLS = F3_DYN + ["POT", "DELV -12"]
F3_FACTORS = {"SHRG": 10.0, "D200": 10.0, "NSST": 10.0, "RSST": 10.0, "IR00": 10.0, "IRM1": 10.0, "IRM3": 10.0,
              "PC00": 100.0, "PCM1": 100.0, "PCM3": 100.0}
_RAW_IR = ["IR00", "IRM1", "IRM3", "PC00", "PCM1", "PCM3"]


def _f3(c: str) -> str:
    return f"CASE WHEN DTL <= 100 THEN NULL ELSE nullif({c}, 9999) / {F3_FACTORS.get(c, 1.0)} END"


_F3_SQL = f"""
g AS (SELECT * FROM cases WHERE case_id NOT IN (SELECT case_id FROM cases WHERE TIME = 0 AND DTL <= 100)),
m AS (SELECT case_id, TIME, BASIN, NAME, DATE_full, {', '.join(f'{_f3(c)} AS {c}' for c in F3_DYN + ["RSST"] + _RAW_IR)} FROM g),
x0 AS (SELECT * REPLACE (CASE WHEN BASIN = 'AFRICA' THEN -Z850 ELSE Z850 END AS Z850,
                         CASE WHEN BASIN IN ('AMERICA', 'EUROPE') THEN NSST ELSE RSST END AS NSST) FROM m),
v0 AS (SELECT case_id, max(VMAX) AS v0 FROM x0 WHERE TIME = 0 GROUP BY case_id),
dm AS (SELECT case_id, max(DELV) AS dm FROM x0 WHERE TIME = -12 GROUP BY case_id),
x AS (SELECT x0.*, x0.VMPI - v0.v0 AS POT, dm.dm AS "DELV -12"
      FROM x0 LEFT JOIN v0 ON x0.case_id = v0.case_id LEFT JOIN dm ON x0.case_id = dm.case_id
      WHERE TIME IN ({', '.join(map(str, FORE))})),
{interp_sql('x', _F3_COLS)},
f0 AS (SELECT case_id, TIME, coalesce(IR00, IRM1, IRM3) AS IR00, coalesce(PC00, PCM1, PCM3) AS PC00 FROM x0),
fs AS (SELECT case_id,
  {', '.join(f'max(CASE WHEN TIME = {s} THEN IR00 END) AS {n}' for s, n in zip(IR_SLOTS, IR_NAMES))},
  {', '.join(f'max(CASE WHEN TIME = {s} THEN PC00 END) AS {n}' for s, n in zip(PC_SLOTS, PC_NAMES))}
  FROM f0 GROUP BY case_id),
f3 AS (SELECT i.case_id, i.TIME, i.NAME || CAST(year(i.DATE_full) AS VARCHAR) AS ATCFID,
         {', '.join('i.' + _q(c) for c in _F3_COLS)}, {', '.join('fs.' + c for c in _IR_COLS)}
       FROM interp i LEFT JOIN fs ON i.case_id = fs.case_id)
"""


@register("case_features", f"""
WITH {_F3_SQL}
SELECT case_id, TIME, ATCFID, {', '.join(f'{R(_q(c))} AS {_q(c)}' for c in _F3_COLS + _IR_COLS)} FROM f3
""", ("cases",))
def q_case_features(spark, sf_dir):
    """F3 + P10 + P11 + P14: sentinel -> scaling -> landfall gate -> land mask ->
    basin rules -> F1 + F2 from one frame, storm id of name and year."""
    return f3(V.cases(spark, sf_dir))


def f3(cases):
    """The case chain with the stand-in basins, divisors and slots."""
    f = features.case_features(cases, CASE, F3_DYN, hours=FORE, carry=["NAME", "DATE_full"],
                               factors=F3_FACTORS, basin_col="BASIN", southern_basin="AFRICA",
                               nsst_basins=["AMERICA", "EUROPE"], ir_slots=IR_SLOTS, ir_names=IR_NAMES,
                               pc_slots=PC_SLOTS, pc_names=PC_NAMES)
    return f.withColumn("ATCFID", F.concat("NAME", F.year("DATE_full").cast("string"))).drop("NAME", "DATE_full", "BASIN")


# -------------------------------------------------- P6, P10, P11, P22 on cases


@register("filter_years", """
SELECT case_id, TIME, YEAR FROM cases WHERE year(DATE_full) IN (1996, 1998)
""", ("cases",))
def q_filter_years(spark, sf_dir):
    """Cases of the chosen years."""
    c = V.cases(spark, sf_dir).select("case_id", "TIME", "YEAR", "DATE_full")
    return clean.filter_years(c, [1996, 1998]).drop("DATE_full")


@register("split_by_year", """
SELECT case_id, YEAR, CASE WHEN year(DATE_full) IN (1997, 2000) THEN 0 ELSE 1 END AS is_TRAIN FROM case_keys
""", ("case_keys",))
def q_split_by_year(spark, sf_dir):
    """train/test flag by held-out years (both sides returned tagged)."""
    k = V.case_keys(spark, sf_dir).select("case_id", "YEAR", "DATE_full")
    train, test = clean.split_by_year(k, [1997, 2000])
    return train.unionByName(test).drop("DATE_full")


@register("flip_hemisphere_sign", f"""
SELECT case_id, TIME, BASIN, CASE WHEN BASIN = 'AFRICA' THEN {R('-Z850')} ELSE {R('Z850')} END AS Z850 FROM cases
""", ("cases",))
def q_flip_hemisphere_sign(spark, sf_dir):
    """P10: Z850 negated in one basin (AFRICA stands for the southern one)."""
    c = V.cases(spark, sf_dir).select("case_id", "TIME", "BASIN", "Z850")
    return clean.flip_hemisphere_sign(c, "Z850", basin="AFRICA")


@register("harmonise_ocean_columns", f"""
SELECT case_id, TIME, BASIN, CASE WHEN BASIN IN ('AMERICA', 'EUROPE') THEN {R('NSST')} ELSE {R('RSST')} END AS NSST FROM cases
""", ("cases",))
def q_harmonise_ocean_columns(spark, sf_dir):
    """NSST where the basin reports it, RSST elsewhere."""
    c = V.cases(spark, sf_dir).select("case_id", "TIME", "BASIN", "NSST", "RSST")
    return clean.harmonise_ocean_columns(c, pairs={"NSST": "RSST"}, nsst_basins=["AMERICA", "EUROPE"])


# ------------------------------------------------ labels, A1, J1, J2, J7, M2

_LABEL_SQL = """
t0 AS (SELECT storm_id, case_id, DATE_full, VMAX FROM cases WHERE TIME = 0),
p0 AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY DATE_full, case_id) AS pos FROM t0),
lab AS (SELECT a.storm_id, a.case_id, a.DATE_full, b.VMAX - a.VMAX AS d24_VMAX,
               CASE WHEN b.VMAX - a.VMAX >= 30 THEN 1 ELSE 0 END AS I_class,
               CASE WHEN b.VMAX - a.VMAX >= 30 THEN 'RI' ELSE 'no RI' END AS "I_class label"
        FROM p0 a JOIN p0 b ON a.storm_id = b.storm_id AND b.pos = a.pos + 1
        WHERE b.DATE_full = a.DATE_full + INTERVAL 1 DAY)
"""
_LABEL_KW = dict(steps=1, gap="1 DAY", tiebreak=["case_id"])


def _hour0(spark, sf_dir):
    """The hour-0 slice labels are computed from, materialized once (the
    TIME filter reaches the lineitem aggregation)."""
    return materialize(V.cases(spark, sf_dir).where("TIME = 0")
                       .select("storm_id", "case_id", "DATE_full", "TIME", "VMAX"))


def _feature_hours(spark, sf_dir):
    """Hours 0-18 with the label and feature columns, materialized once: the
    labels and the averaged features both read it."""
    cols = ["storm_id", "case_id", "DATE_full", "TIME"] + list(dict.fromkeys(["VMAX"] + _TF))
    return materialize(V.cases(spark, sf_dir).where("TIME IN (0, 6, 12, 18)").select(*cols))


@register("case_labels", f"""
WITH {_LABEL_SQL}
SELECT storm_id, case_id, DATE_full, {R('d24_VMAX')} AS d24_VMAX, I_class, "I_class label" FROM lab
""", ("cases",))
def q_case_labels(spark, sf_dir):
    """W1 + P20 at hour 0 on cases (next case of the storm exactly 1 day later)."""
    return features.case_labels(_hour0(spark, sf_dir), ["storm_id"], ["case_id"], "DATE_full", **_LABEL_KW)


@register("attach_label", f"""
WITH {_LABEL_SQL}
SELECT c.case_id, c.TIME, lab.I_class FROM cases c LEFT JOIN lab ON c.case_id = lab.case_id
""", ("cases",))
def q_attach_label(spark, sf_dir):
    """Case label left-joined onto every hour of the case."""
    lab = features.case_labels(_hour0(spark, sf_dir), ["storm_id"], ["case_id"], "DATE_full", **_LABEL_KW)
    return features.attach_label(V.cases(spark, sf_dir).select("case_id", "TIME"),
                                 lab.select("case_id", "I_class"), ["case_id"])


_AVG = ["SHRG", "VMAX", "DELV", "IR00"]


@register("average_forecast_hours", f"""
SELECT case_id, {', '.join(f"{R(f'avg(nullif({c}, 9999))')} AS {c}" for c in _AVG)}
FROM cases WHERE TIME IN (0, 6, 12, 18) GROUP BY case_id
""", ("cases",))
def q_average_forecast_hours(spark, sf_dir):
    """A1: per-case mean over hours 0-18 of the cleaned features."""
    c = clean.sentinel_to_null(V.cases(spark, sf_dir).select("case_id", "TIME", *_AVG), _AVG)
    return features.average_hours(c, ["case_id"], _AVG)


@register("spread_hours_wide", f"""
SELECT case_id, {', '.join(f"{R(f'max(CASE WHEN TIME = {h} THEN nullif({c}, 9999) END)')} AS {c}_T{h}" for h in (0, 6, 12, 18) for c in ("SHRG", "VMAX"))}
FROM cases WHERE TIME IN (0, 6, 12, 18) GROUP BY case_id
""", ("cases",))
def q_spread_hours_wide(spark, sf_dir):
    """One column set per hour 0/6/12/18 per case."""
    c = clean.sentinel_to_null(V.cases(spark, sf_dir).select("case_id", "TIME", "SHRG", "VMAX"), ["SHRG"])
    return features.spread_hours_wide(c, ["case_id"], ["SHRG", "VMAX"])


_TF = ["SHRG", "VMAX", "DELV", "D200", "IR00"]
_TF_SQL = f"""
feat AS (SELECT storm_id, case_id, DATE_full, {', '.join(f'avg(nullif({c}, 9999)) AS {c}' for c in _TF)}
         FROM cases WHERE TIME IN (0, 6, 12, 18) GROUP BY storm_id, case_id, DATE_full),
tf AS (SELECT f.*, lab.d24_VMAX, lab.I_class, lab."I_class label" FROM feat f
       JOIN lab ON f.storm_id = lab.storm_id AND f.case_id = lab.case_id AND f.DATE_full = lab.DATE_full
       WHERE {' AND '.join(f'f.{c} IS NOT NULL' for c in _TF)})
"""


@register("align_features_labels", f"""
WITH {_LABEL_SQL}, {_TF_SQL}
SELECT storm_id, case_id, DATE_full, {', '.join(f'{R(c)} AS {c}' for c in _TF)}, {R('d24_VMAX')} AS d24_VMAX,
       I_class, "I_class label" FROM tf
""", ("cases",))
def q_align_features_labels(spark, sf_dir):
    """Complete averaged features of labelled cases with their labels."""
    c = _feature_hours(spark, sf_dir)
    lab = features.case_labels(c, ["storm_id"], ["case_id"], "DATE_full", **_LABEL_KW)
    keys = ["storm_id", "case_id", "DATE_full"]
    feats = features.average_hours(clean.sentinel_to_null(c, _TF), keys, _TF)
    return features.align_features_labels(feats, lab, keys, ["d24_VMAX", "I_class", "I_class label"])


@register("training_frame", f"""
WITH {_LABEL_SQL}, {_TF_SQL}
SELECT storm_id, case_id, DATE_full, {', '.join(f'{R(c)} AS {c}' for c in _TF)}, {R('d24_VMAX')} AS d24_VMAX,
       I_class, "I_class label" FROM tf
""", ("cases",))
def q_training_frame(spark, sf_dir):
    """M2: label (W1+P20), average hours 0-18 (A1), align (J2) in one job."""
    c = clean.sentinel_to_null(_feature_hours(spark, sf_dir), _TF)
    return features.training_frame(c, ["storm_id"], ["case_id"], "DATE_full", _TF, **_LABEL_KW)


@register("drop_feature_columns", f"""
SELECT case_id, TIME, {R('VMAX')} AS VMAX, {R('VMPI')} AS VMPI, {R('DELV')} AS DELV FROM hours
""", ("hours",))
def q_drop_feature_columns(spark, sf_dir):
    """Bookkeeping / non-feature columns removed."""
    h = V.hours(spark, sf_dir).select("case_id", "TIME", "VMAX", "VMPI", "DELV", "DTL", "SHRG")
    return clean.drop_feature_columns(h, ["DTL", "SHRG"])
