"""Evaluation of fitted models from one saved prediction store.

Predictions are saved once, bucketed and sorted by (model, draw, basin, cell of the
probability). The counts that all tables need are one aggregate whose keys
contain the bucket columns, so it reads the store without a shuffle, and a hot
(model, draw, basin) is spread over its cells. Everything after works on counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gale.operators import verify
from gale.session import materialize
from gale.sources.results import shared_path

KEYS = ["Model", "draw", "BASIN"]
CELLS = 64  # of the probability: parts of one (model, draw, basin)


def save_predictions(pred: DataFrame, buckets: int | None = None) -> DataFrame:
    """The saved store of prediction rows (Model, draw, BASIN, keys, y_true, y_pred, p0,
    p1, as :func:`gale.operators.models.predict` makes them), re-read as a bucketed table."""
    spark = pred.sparkSession
    name = f"predictions_{uuid.uuid4().hex[:12]}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = F.least(F.floor(F.col("p1") * CELLS), F.lit(CELLS - 1)).cast("int")
    rows = pred.withColumn("cell", cell)
    rows.repartition(n, *KEYS, "cell").write.bucketBy(n, *KEYS, "cell").sortBy(*KEYS, "p1") \
        .option("path", shared_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def prediction_counts(store: DataFrame) -> DataFrame:
    """(model, draw, basin, cell, probability, truth, prediction) -> n: no exchange over the store."""
    return store.groupBy(*KEYS, "cell", "p1", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def evaluation_tables(store: DataFrame, classes: list[int], names: dict[int, str] | None = None,
                      importance: DataFrame | None = None, event: int = 1) -> dict[str, DataFrame]:
    """The reference's seven tables for every model and draw, each basin and ALL:
    predictions, report (A8), contingency (A7), brier (A9), precision_recall (A10),
    roc with areas (A12), and the importance table (M13) that is given, if any."""
    basins = materialize(prediction_counts(store).drop("cell"))
    counts = materialize(verify.with_all_scope(basins, "BASIN", ["n"], ["Model", "draw", "p1", "y_true", "y_pred"]))
    classed = counts.groupBy(*KEYS, "y_true", "y_pred").agg(F.sum("n").alias("n"))
    y = (F.col("y_true") == event).cast("bigint")
    by_score = counts.groupBy(*KEYS, F.col("p1").alias("score")).agg(
        F.sum(y * F.col("n")).alias("tp_c"), F.sum((1 - y) * F.col("n")).alias("fp_c"))
    cum = materialize(verify.cumulative_table(by_score, KEYS))
    sums = counts.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum((y * F.col("n")).cast("double")).alias("pos"),
                                     F.sum(F.col("n") * F.pow(F.col("p1") - y, 2)).alias("sse"))
    scope = F.explode(F.array(F.col("BASIN"), F.lit(verify.ALL))).alias("Predicted_Basin")
    out = {"predictions": store.drop("cell").select("*", scope),
           "report": verify.report_from_counts(classed, KEYS, "y_true", "y_pred"),
           "contingency": verify.contingency_from_counts(classed, KEYS, "y_true", "y_pred", classes, names),
           "brier": verify.brier_from_sums(sums, KEYS),
           "precision_recall": verify.precision_recall_curve(None, KEYS, cum=cum),
           "roc": verify.roc_curve(None, KEYS, cum=cum)}
    if importance is not None:
        out["importance"] = importance
    return out


def stacked(tables: dict[str, DataFrame], items: dict[str, list[str]]) -> DataFrame:
    """All tables as rows (table, Model, draw, BASIN, item, metric, value): ``items`` names
    the columns that tell a table's rows apart inside (model, draw, basin)."""
    out = None
    for name, df in tables.items():
        basin = "Predicted_Basin" if "Predicted_Basin" in df.columns else "BASIN"
        told = items[name]
        values = [c for c in df.columns if c not in {*KEYS, basin, *told} and dict(df.dtypes)[c] != "string"]
        item = F.concat_ws("|", *[F.col(c).cast("string") for c in told])
        metrics = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])).alias("m")
        rows = df.select(F.lit(name).alias("table"), "Model", "draw", F.col(basin).alias("BASIN"), item.alias("item"), metrics) \
            .select("table", "Model", "draw", "BASIN", "item", "m.metric", "m.value")
        out = rows if out is None else out.unionByName(rows)
    return out
