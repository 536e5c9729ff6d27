"""Exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gale.operators import clean, explore, features
from gale.plans import views as V
from gale.plans.catalog import R, register
from gale.plans.q_series import _W1_SQL, _w1

_LAB_BASIN_SQL = """
t0 AS (SELECT storm_id, case_id, BASIN, DATE_full, VMAX FROM cases WHERE TIME = 0),
p0 AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY DATE_full, case_id) AS pos FROM t0),
lab AS (SELECT a.BASIN, CASE WHEN b.VMAX - a.VMAX >= 30 THEN 1 ELSE 0 END AS I_class
        FROM p0 a JOIN p0 b ON a.storm_id = b.storm_id AND b.pos = a.pos + 1
        WHERE b.DATE_full = a.DATE_full + INTERVAL 1 DAY)
"""


@register("class_weights", f"""
WITH {_LAB_BASIN_SQL},
c AS (SELECT BASIN, I_class, count(*) AS CASES FROM lab GROUP BY ALL
      UNION ALL SELECT 'ALL', I_class, count(*) FROM lab GROUP BY I_class),
t AS (SELECT BASIN, sum(CASES) AS tot FROM c GROUP BY BASIN)
SELECT c.BASIN, c.I_class, c.CASES, {R('c.CASES / t.tot')} AS FRAC, {R('t.tot / c.CASES')} AS WEIGHT
FROM c JOIN t ON c.BASIN = t.BASIN
""", ("cases",))
def q_class_weights(spark, sf_dir):
    """A2: class shares per basin and ALL, weight = 1 / share."""
    from gale.session import materialize
    # only the hour-0 rows take part in labelling: materialize that slice, then the labels
    t0 = materialize(V.cases(spark, sf_dir).where("TIME = 0").select("storm_id", "case_id", "BASIN",
                                                                       "DATE_full", "TIME", "VMAX"))
    lab = features.case_labels(t0, ["storm_id"], ["case_id", "BASIN"], "DATE_full", steps=1, tiebreak=["case_id"])
    return explore.class_weights(materialize(lab.select("BASIN", "I_class")), "BASIN", "I_class")


@register("count_cases", """
SELECT BASIN, YEAR, count(*) AS n FROM case_keys GROUP BY ROLLUP (BASIN, YEAR)
""", ("case_keys",))
def q_count_cases(spark, sf_dir):
    """A3: case counts by basin and year with subtotals (rollup)."""
    return explore.count_cases(V.case_keys(spark, sf_dir), ["BASIN", "YEAR"])


@register("event_counts_by_class", f"""
WITH {_W1_SQL}
SELECT grp, CASE WHEN d24_VMAX >= 30 THEN 1 ELSE 0 END AS I_class, count(d24_VMAX) AS n FROM w1 GROUP BY ALL
""", ("cycles",))
def q_event_counts_by_class(spark, sf_dir):
    """A3: labelled changes counted per group and class."""
    from gale.functions.labels import intensity_class
    d = _w1(spark, sf_dir).withColumn("I_class", intensity_class("d24_VMAX", 2))
    return d.groupBy("grp", "I_class").agg(F.count("d24_VMAX").alias("n"))


@register("percentile_by_basin", f"""
WITH {_W1_SQL}
SELECT grp, {R('quantile_cont(d24_VMAX, 0.95)')} AS p95 FROM w1 GROUP BY grp
""", ("cycles",))
def q_percentile_by_basin(spark, sf_dir):
    """A5: exact 95th percentile (linear) of the 24-h change per group."""
    return explore.exact_quantiles(_w1(spark, sf_dir, materialized=True), ["grp"], "d24_VMAX", {"p95": 0.95})


@register("box_stats", f"""
SELECT BASIN, {R('quantile_cont(VMAX, 0.25)')} AS q25, {R('quantile_cont(VMAX, 0.5)')} AS q50,
       {R('quantile_cont(VMAX, 0.75)')} AS q75 FROM cases WHERE TIME = 0 GROUP BY BASIN
""", ("cases",))
def q_box_stats(spark, sf_dir):
    """Quartiles per basin (distributed exact order statistics)."""
    from gale.session import materialize
    c = materialize(V.cases(spark, sf_dir).where(F.col("TIME") == 0).select("BASIN", "VMAX"))
    return explore.exact_quantiles(c, ["BASIN"], "VMAX", {"q25": 0.25, "q50": 0.5, "q75": 0.75})


_CORR = ["SHRG", "VMAX", "DELV", "D200", "IR00", "VMPI"]


@register("feature_correlation", f"""
WITH x AS (SELECT {', '.join(f'nullif({c}, 9999) AS {c}' for c in _CORR)} FROM hours),
p AS ({' UNION ALL '.join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM x"
                          for i, a in enumerate(_CORR) for b in _CORR[i + 1:])})
SELECT feature_a, feature_b, {R('r')} AS r FROM p WHERE abs(r) >= 0.0
""", ("hours",))
def q_feature_correlation(spark, sf_dir):
    """Pearson r of every feature pair (upper triangle), one pass."""
    h = clean.sentinel_to_null(V.hours(spark, sf_dir).select(*_CORR), _CORR)
    return explore.pearson_pairs(h, _CORR, 0.0)


@register("histogram", f"""
WITH {_W1_SQL}
SELECT grp, CAST(floor(d24_VMAX / 10) * 10 AS DOUBLE) AS bin_left, count(*) AS n FROM w1 GROUP BY ALL
""", ("cycles",))
def q_histogram(spark, sf_dir):
    """Fixed-width (10) histogram of the 24-h change per group."""
    return explore.histogram_fixed(_w1(spark, sf_dir), ["grp"], "d24_VMAX", 10.0)


@register("histogram_equal", f"""
WITH r AS (SELECT min(prob) AS lo, max(prob) AS hi FROM forecasts),
b AS (SELECT CAST(least(floor((prob - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, lo, hi FROM forecasts, r)
SELECT bin, count(*) AS n, {R('min(lo) + bin * ((min(hi) - min(lo)) / 10)')} AS bin_left FROM b GROUP BY bin
""", ("forecasts",))
def q_histogram_equal(spark, sf_dir):
    """Ten equal bins between min and max forecast probability."""
    return explore.histogram_equal(V.forecasts(spark, sf_dir), "prob", 10)


@register("density_by_basin", f"""
WITH {_W1_SQL},
st AS (SELECT grp, count(*) AS n, stddev_samp(d24_VMAX) * pow(count(*), -0.2) AS h FROM w1 GROUP BY grp),
d AS (SELECT grp, d24_VMAX AS x, count(*) AS c FROM w1 GROUP BY ALL),
g AS (SELECT -60.0 + k * 1.0 AS gx FROM range(0, 121) t(k))
SELECT d.grp, {R('gx')} AS x, {R('sum(c * exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (min(n) * min(h) * sqrt(2 * pi()))')} AS density
FROM d JOIN st ON d.grp = st.grp CROSS JOIN g WHERE h > 0 GROUP BY d.grp, gx
""", ("cycles",))
def q_density_by_basin(spark, sf_dir):
    """Gaussian KDE (Scott bandwidth) of the 24-h change per group."""
    return explore.gaussian_kde(_w1(spark, sf_dir, materialized=True), ["grp"], "d24_VMAX", (-60.0, 60.0, 121))


@register("mean_probability_by_storm", f"""
SELECT storm_id, DATE_full, {R('avg(prob)')} AS mean_prob FROM forecasts GROUP BY ALL
""", ("forecasts",))
def q_mean_probability_by_storm(spark, sf_dir):
    """Mean forecast probability per storm and time."""
    return explore.mean_by(V.forecasts(spark, sf_dir), ["storm_id", "DATE_full"], "prob", "mean_prob")


@register("distinct_values", "SELECT DISTINCT Tech FROM forecasts", ("forecasts",))
def q_distinct_values(spark, sf_dir):
    """Distinct techniques."""
    return explore.distinct_values(V.forecasts(spark, sf_dir), ["Tech"])


@register("standardise_columns", f"""
WITH x AS (SELECT case_id, TIME, VMAX, nullif(SHRG, 9999) AS SHRG FROM hours),
s AS (SELECT avg(VMAX) AS mv, stddev_samp(VMAX) AS sv, avg(SHRG) AS ms, stddev_samp(SHRG) AS ss FROM x)
SELECT case_id, TIME, {R('(VMAX - mv) / sv')} AS VMAX, {R('(SHRG - ms) / ss')} AS SHRG FROM x, s
""", ("hours",))
def q_standardise_columns(spark, sf_dir):
    """Z-scores with the sample standard deviation."""
    h = clean.sentinel_to_null(V.hours(spark, sf_dir).select("case_id", "TIME", "VMAX", "SHRG"), ["SHRG"])
    return explore.standardise(h, ["VMAX", "SHRG"])
