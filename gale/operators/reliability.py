"""Reliability tables and consensus.

A reliability table is one grouped aggregate over (model, basin, bin), so it
scales with partial aggregation; the forecast/observation match is an equi
join on the storm key and valid time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gale.functions.numeric import count_if, safe_div
from gale.operators.clean import bin_probability


def reliability_from_predictions(pred: DataFrame, model_col: str, basin_col: str, prob_col: str,
                                 y_true: str, *, scale: float = 100.0, drop_top_bin: bool = True,
                                 event: int = 1) -> DataFrame:
    """Per (model, basin, probability bin): total, events, observed %.

    Bins follow P23; the 100 % bin is left out when ``drop_top_bin``. A bin
    without events has 0 events and 0 %."""
    b = bin_probability(prob_col, scale)
    x = pred.select(F.col(model_col).alias("Model"), F.col(basin_col).alias("Predicted_Basin"),
                    b.alias("Predicted_Pct"), (F.col(y_true) == event).alias("_ev"))
    if drop_top_bin:
        x = x.where(F.col("Predicted_Pct") != 100)
    return _table(x, ["Model", "Predicted_Basin", "Predicted_Pct"])


def _table(x: DataFrame, keys: list[str]) -> DataFrame:
    g = x.groupBy(*keys).agg(count_if(F.col("_ev")).alias("Observed_No_RI"),
                             F.count(F.lit(1)).alias("Observed_No_Total"))
    return g.withColumn("Observed_Pct", F.lit(100.0) * safe_div("Observed_No_RI", "Observed_No_Total"))


def verify_forecasts(forecasts: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Forecasts matched to observations on the common keys (inner
    equi-join = intersection of the key sets)."""
    return forecasts.join(observed, keys, "inner")


def restrict_to_predicted(forecasts: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Keep forecasts whose keys were also predicted (left semi join)."""
    return forecasts.join(predicted.select(*keys), keys, "left_semi")


def reliability_from_products(matched: DataFrame, tech_col: str, basin_col: str, prob_col: str,
                              change_col: str, *, threshold: float = 30.0,
                              drop_outliers_above: float = 1000.0) -> DataFrame:
    """Per (technique, basin, probability bin) of matched forecasts:
    total, observed events (change >= threshold) and observed %. Probability
    is already in percent; bins at or above ``drop_outliers_above`` are
    dropped (P17)."""
    b = bin_probability(prob_col, 1.0)
    x = matched.select(F.col(tech_col).alias("Model"), F.col(basin_col).alias("Predicted_Basin"),
                       b.alias("Predicted_Pct"), (F.col(change_col) >= threshold).alias("_ev"))
    x = x.where(F.col("Predicted_Pct") < drop_outliers_above)
    return _table(x, ["Model", "Predicted_Basin", "Predicted_Pct"])


def consensus_reliability(model: DataFrame, products: DataFrame, member_sets: dict[str, list[str]],
                          model_name: str = "Random Forest") -> DataFrame:
    """For each named set, the mean over the model's row and the rows of
    the set's products per (basin, bin): observed %, events and totals, zeros
    treated as missing. ``model``: reliability rows of the one chosen model.
    The set table is the fixed definition (a handful of rows), so it is
    broadcast."""
    spark = products.sparkSession
    sets = spark.createDataFrame([(s, m) for s, ms in member_sets.items() for m in [model_name, *ms]],
                                 "Consensus string, Model string")
    cols = ["Model", "Predicted_Basin", "Predicted_Pct", "Observed_Pct", "Observed_No_RI", "Observed_No_Total"]
    both = model.withColumn("Model", F.lit(model_name)).select(*cols).unionByName(products.select(*cols))
    return both.join(F.broadcast(sets), "Model").groupBy("Consensus", "Predicted_Basin", "Predicted_Pct").agg(
        *[F.avg(F.nullif(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in cols[3:]],
        F.count(F.lit(1)).alias("n_members"))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Append tables, missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def except_models(df: DataFrame, models: list[str], model_col: str = "Model") -> DataFrame:
    """Drop the named models from a result."""
    return df.where(~F.col(model_col).isin(models))


def sort_curve(df: DataFrame, cols: list[str]) -> DataFrame:
    """T5: order a curve table for presentation."""
    return df.orderBy(*cols)
