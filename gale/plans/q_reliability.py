"""Reliability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gale.functions.names import basin_code, lookup
from gale.operators import reliability as rel
from gale.operators import series
from gale.operators.clean import bin_probability
from gale.plans import views as V
from gale.plans.catalog import R, register
from gale.plans.render import TECH_CODES

# The product sets joined with the model in a consensus.
PRODUCT_SETS = {
    "FRIA": ["FRIA"],
    "RIPA_FRIA": ["RAPC", "FRIA"],
    "RII_FRIA": ["FRIA", "RIOD"],
    "RII_RIPA": ["RAPC", "RIOD"],
    "SHIPS-RII": ["RIOD"],
    "ALL": ["RAPC", "FRIA", "RIOD"],
}
# Stand-in basins: regions and event types renamed into basin names.
REGION_BASINS = {"AMERICA": "ATLANTIC", "EUROPE": "EAST_PACIFIC", "ASIA": "WEST_PACIFIC", "AFRICA": "SOUTHERN_HEM"}
TYPE_BASINS = {"click": "ATLANTIC", "error": "EAST_PACIFIC", "purchase": "WEST_PACIFIC", "signup": "SOUTHERN_HEM",
               "view": "CENTRAL_PACIFIC"}


def _bin_sql(x: str) -> str:
    b = f"round_even(CAST({x} AS DOUBLE) / 10, 0) * 10"
    return f"CASE WHEN {b} <= 5 THEN 5.0 ELSE {b} END"


@register("bin_probability", f"""
SELECT case_key, Model, {R(_bin_sql('p1 * 100'))} AS Predicted_Pct FROM scored
""", ("scored",))
def q_bin_probability(spark, sf_dir):
    """Probability to percent, rounded to tens (half-even), <= 5 -> 5."""
    s = V.scored(spark, sf_dir)
    return s.select("case_key", "Model", bin_probability("p1").alias("Predicted_Pct"))


_A16_SQL = f"""
b AS (SELECT Model, BASIN AS Predicted_Basin, {_bin_sql('p1 * 100')} AS Predicted_Pct, y_true FROM scored),
a16 AS (SELECT Model, Predicted_Basin, Predicted_Pct, CAST(count(*) FILTER (WHERE y_true = 1) AS BIGINT) AS Observed_No_RI,
          count(*) AS Observed_No_Total, 100.0 * count(*) FILTER (WHERE y_true = 1) / count(*) AS Observed_Pct
        FROM b WHERE Predicted_Pct <> 100 GROUP BY ALL)
"""
_REL_OUT = f"Model, Predicted_Basin, {R('Predicted_Pct')} AS Predicted_Pct, Observed_No_RI, Observed_No_Total, {R('Observed_Pct')} AS Observed_Pct"


def _a16(spark, sf_dir):
    return rel.reliability_from_predictions(V.scored(spark, sf_dir), "Model", "BASIN", "p1", "y_true")


@register("reliability_models", f"WITH {_A16_SQL} SELECT {_REL_OUT} FROM a16", ("scored",))
def q_reliability_models(spark, sf_dir):
    """Observed event % per model, basin and forecast-probability bin."""
    return _a16(spark, sf_dir)


_TRACK_SQL = """
p AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY DATE_full) AS pos FROM cycles),
trk AS (SELECT a.storm_id, a.DATE_full, a.grp,
          CASE WHEN b.DATE_full = a.DATE_full + INTERVAL 1 DAY THEN b.VMAX - a.VMAX END AS d24_VMAX
        FROM p a LEFT JOIN p b ON a.storm_id = b.storm_id AND b.pos = a.pos + 4),
m AS (SELECT f.storm_id, f.DATE_full, f.Tech, f.prob, t.grp, t.d24_VMAX FROM forecasts f
      JOIN trk t ON f.storm_id = t.storm_id AND f.DATE_full = t.DATE_full)
"""


def _matched(spark, sf_dir):
    trk = series.track_change(V.cycles(spark, sf_dir, materialized=True), ["storm_id"], "DATE_full", ("VMAX",))
    fc = V.forecasts(spark, sf_dir).select("storm_id", "DATE_full", "Tech", "prob")
    return rel.verify_forecasts(fc, trk.select("storm_id", "DATE_full", "grp", "d24_VMAX"),
                                ["storm_id", "DATE_full"])


@register("verify_forecasts", f"""
WITH {_TRACK_SQL}
SELECT storm_id, DATE_full, Tech, {R('prob')} AS prob, grp, {R('d24_VMAX')} AS d24_VMAX FROM m
""", ("cycles", "forecasts"))
def q_verify_forecasts(spark, sf_dir):
    """Forecasts matched to the observed 24-h change on (storm, time)."""
    return _matched(spark, sf_dir)


@register("restrict_to_predicted", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY DATE_full) AS pos FROM cycles),
w1 AS (SELECT a.storm_id, a.DATE_full FROM p a JOIN p b ON a.storm_id = b.storm_id AND b.pos = a.pos + 4
       WHERE b.DATE_full = a.DATE_full + INTERVAL 1 DAY)
SELECT storm_id, DATE_full, Tech, {R('prob')} AS prob FROM forecasts f
WHERE EXISTS (SELECT 1 FROM w1 WHERE w1.storm_id = f.storm_id AND w1.DATE_full = f.DATE_full)
""", ("cycles", "forecasts"))
def q_restrict_to_predicted(spark, sf_dir):
    """Forecasts at times that carry a W1 label (left semi join)."""
    w1 = series.change_24h(V.cycles(spark, sf_dir, materialized=True), ["storm_id"], "DATE_full", ["VMAX"])
    fc = V.forecasts(spark, sf_dir).select("storm_id", "DATE_full", "Tech", "prob")
    return rel.restrict_to_predicted(fc, w1, ["storm_id", "DATE_full"])


_A15_SQL = f"""
{_TRACK_SQL},
bb AS (SELECT Tech AS Model, grp AS Predicted_Basin, {_bin_sql('prob')} AS Predicted_Pct, d24_VMAX >= 30 AS ev FROM m),
a15 AS (SELECT Model, Predicted_Basin, Predicted_Pct, CAST(count(*) FILTER (WHERE ev) AS BIGINT) AS Observed_No_RI,
          count(*) AS Observed_No_Total, 100.0 * count(*) FILTER (WHERE ev) / count(*) AS Observed_Pct
        FROM bb WHERE Predicted_Pct < 1000 GROUP BY ALL)
"""


def _a15(spark, sf_dir):
    return rel.reliability_from_products(_matched(spark, sf_dir), "Tech", "grp", "prob", "d24_VMAX")


@register("reliability_products", f"WITH {_A15_SQL} SELECT {_REL_OUT} FROM a15", ("cycles", "forecasts"))
def q_reliability_products(spark, sf_dir):
    """Observed event % per technique, basin and bin of matched forecasts."""
    return _a15(spark, sf_dir)


_SETS_SQL = " UNION ALL ".join(f"SELECT '{s}' AS Consensus, '{m}' AS Model"
                               for s, ms in PRODUCT_SETS.items() for m in ["Random Forest", *ms])
_TYPE_CODE_SQL = "CASE grp WHEN 'click' THEN 'AL' WHEN 'purchase' THEN 'WP' WHEN 'signup' THEN 'SH' ELSE 'EP' END"
_TECH_CODE_SQL = ("CASE Tech WHEN 'click' THEN 'RIOC' WHEN 'view' THEN 'RIOD' WHEN 'purchase' THEN 'LDA0' "
                  "WHEN 'signup' THEN 'RAPC' ELSE 'FRIA' END")


@register("consensus_reliability", f"""
WITH {_TRACK_SQL}, {_A16_SQL},
bb AS (SELECT {_TECH_CODE_SQL} AS Model, {_TYPE_CODE_SQL} AS Predicted_Basin, {_bin_sql('prob')} AS Predicted_Pct,
         d24_VMAX >= 30 AS ev FROM m),
a15 AS (SELECT Model, Predicted_Basin, Predicted_Pct, CAST(count(*) FILTER (WHERE ev) AS BIGINT) AS Observed_No_RI,
          count(*) AS Observed_No_Total, 100.0 * count(*) FILTER (WHERE ev) / count(*) AS Observed_Pct
        FROM bb WHERE Predicted_Pct < 1000 GROUP BY ALL),
every AS (SELECT 'Random Forest' AS Model, CASE Predicted_Basin WHEN 'AMERICA' THEN 'AL' WHEN 'EUROPE' THEN 'EP'
            WHEN 'ASIA' THEN 'WP' WHEN 'AFRICA' THEN 'SH' ELSE Predicted_Basin END AS Predicted_Basin,
            Predicted_Pct, Observed_No_RI, Observed_No_Total, Observed_Pct FROM a16 WHERE Model = 'O'
          UNION ALL SELECT * FROM a15),
sets AS ({_SETS_SQL})
SELECT Consensus, Predicted_Basin, {R('Predicted_Pct')} AS Predicted_Pct,
       {R('avg(nullif(Observed_Pct, 0.0))')} AS Observed_Pct, {R('avg(nullif(Observed_No_RI, 0))')} AS Observed_No_RI,
       {R('avg(nullif(Observed_No_Total, 0))')} AS Observed_No_Total, count(*) AS n_members
FROM every JOIN sets USING (Model) GROUP BY ALL
""", ("scored", "cycles", "forecasts"))
def q_consensus_reliability(spark, sf_dir):
    """A17 + P12: the chosen model's table averaged with each named product
    set's (zeros as missing), basins as codes."""
    model = _a16(spark, sf_dir).where("Model = 'O'")
    model = model.withColumn("Predicted_Basin", basin_code(lookup("Predicted_Basin", REGION_BASINS)))
    m = _matched(spark, sf_dir).withColumns({"Tech": lookup("Tech", TECH_CODES),
                                             "grp": basin_code(lookup("grp", TYPE_BASINS))})
    products = rel.reliability_from_products(m, "Tech", "grp", "prob", "d24_VMAX")
    return rel.consensus_reliability(model, products, PRODUCT_SETS)


@register("union_by_name", f"""
WITH {_A16_SQL}, {_A15_SQL}
SELECT {_REL_OUT}, 'model' AS source FROM a16
UNION ALL SELECT {_REL_OUT}, NULL FROM a15
""", ("scored", "cycles", "forecasts"))
def q_union_by_name(spark, sf_dir):
    """Model and product tables appended by name (missing columns null)."""
    return rel.union_by_name([_a16(spark, sf_dir).withColumn("source", F.lit("model")), _a15(spark, sf_dir)])


@register("intersect_keys", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY DATE_full) AS pos FROM cycles),
w1 AS (SELECT a.storm_id, a.DATE_full FROM p a JOIN p b ON a.storm_id = b.storm_id AND b.pos = a.pos + 4
       WHERE b.DATE_full = a.DATE_full + INTERVAL 1 DAY)
SELECT storm_id, DATE_full FROM forecasts WHERE Tech = 'click' INTERSECT SELECT storm_id, DATE_full FROM w1
""", ("cycles", "forecasts"))
def q_intersect_keys(spark, sf_dir):
    """(storm, time) keys common to one technique's forecasts and the labels."""
    w1 = series.change_24h(V.cycles(spark, sf_dir, materialized=True), ["storm_id"], "DATE_full", ["VMAX"])
    fc = V.forecasts(spark, sf_dir).where(F.col("Tech") == "click")
    return fc.select("storm_id", "DATE_full").intersect(w1.select("storm_id", "DATE_full"))


@register("except_models", f"WITH {_A15_SQL} SELECT {_REL_OUT} FROM a15 WHERE Model NOT IN ('click', 'error')",
          ("cycles", "forecasts"))
def q_except_models(spark, sf_dir):
    """Product table without the named techniques."""
    return rel.except_models(_a15(spark, sf_dir), ["click", "error"])


@register("sort_curve", f"WITH {_A16_SQL} SELECT {_REL_OUT} FROM a16", ("scored",))
def q_sort_curve(spark, sf_dir):
    """T5: reliability table ordered by model, basin and predicted %."""
    return rel.sort_curve(_a16(spark, sf_dir), ["Model", "Predicted_Basin", "Predicted_Pct"])
