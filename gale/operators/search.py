"""Resumable model search over draws, folds and grid points.

A full experiment is draws x models x repeats x folds x grid points fits. The
training frame is written once; a draw's held-out years and the folds of every repeat
are columns and filters of it, not copies. The scores of a fold's grid points are
appended to a result store in the shared folder when the fold is done, keyed by
(draw, model, repeat, fold, point): a run that is started again skips what the store
has, whatever ended the one before. The grid points of a fold run at the same time,
each in its own scheduler pool (``spark.scheduler.mode=FAIR`` shares the executors
between them; without it they queue).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gale.operators import sampling, verify
from gale.session import materialize

SCHEMA = "draw int, model string, repeat int, fold int, point int, score double"


@dataclass(frozen=True)
class Spec:
    """A model of the search: its grid, how one point is fitted, what is done to training rows first."""
    name: str
    grid: list[dict]
    fit: Callable
    prepare: Callable = lambda rows: rows


class ResultStore:
    """Scores of finished fits, one small file a fold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.add([])  # the table exists before the first result

    def add(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        """Every finished point once (a fold that was cut off and run again may be there twice)."""
        return self.spark.read.schema(SCHEMA).parquet(self.path).dropDuplicates(["draw", "model", "repeat", "fold", "point"])

    def done(self) -> set[tuple]:
        """(draw, model, repeat, fold, point): as many as the experiment has fits, whatever the data."""
        return {tuple(r)[:5] for r in self.table().collect()}


def run_search(frame: DataFrame, draws: list[tuple[int, list]], specs: list[Spec], store: ResultStore, *, key: str, class_col: str,
               label: str, year_col: str, k: int = 10, repeats: int = 3, seed: int = 0, parallelism: int = 4) -> int:
    """Weighted F1 of every (draw, model, repeat, fold, point) that the store lacks;
    returns how many were fitted. ``draws``: (draw, years held out of it). Folds
    stratify the classes (M8); ``prepare`` sees a fold's training rows only."""
    spark, fitted, have = frame.sparkSession, 0, store.done()
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="weightedFMeasure")
    for draw, years in draws:
        points = [(s, r, f) for s in specs for r in range(repeats) for f in range(k)
                  if any((draw, s.name, r, f, p) not in have for p in range(len(s.grid)))]
        if not points:
            continue
        folded = frame.where(~F.col(year_col).isin(years))
        for r in sorted({r for _, r, _ in points}):
            folded = sampling.stratified_folds(folded, key, class_col, k, repeat=r, seed=seed, out_col=f"_fold{r}")
        folded = materialize(folded)
        folds = [c for c in folded.columns if c.startswith("_fold")]
        for spec, r, f in points:
            part = materialize(spec.prepare(folded.where(F.col(f"_fold{r}") != f).drop(*folds)))
            held = folded.where(F.col(f"_fold{r}") == f).drop(*folds)
            check_classes(part, held, class_col, f"draw {draw}, {spec.name}, repeat {r}, fold {f}")
            todo = [p for p in range(len(spec.grid)) if (draw, spec.name, r, f, p) not in have]

            def score(p, spec=spec, part=part, held=held):
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"point-{p % parallelism}")
                return float(ev.evaluate(spec.fit(part, spec.grid[p]).transform(held)))
            with ThreadPool(parallelism) as pool:
                scores = pool.map(score, todo)
            store.add([(draw, spec.name, r, f, p, s) for p, s in zip(todo, scores)])
            fitted += len(todo)
    return fitted


def check_classes(part: DataFrame, held: DataFrame, class_col: str, where: str) -> None:
    """Both classes in the training rows, some rows held out; else an error, never a silent refit."""
    if part.select(class_col).distinct().count() < 2 or held.isEmpty():
        raise ValueError(f"{where}: needs rows of two classes and rows to score")


def best_points(scores: DataFrame, folds: int) -> DataFrame:
    """(draw, model, point, score): the grid point with the largest mean score over all
    ``folds`` folds and repeats (ties: the first point). A point with missing folds is an error."""
    mean = scores.groupBy("draw", "model", "point").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))
    mean = mean.withColumn("score", F.when(F.col("n") == folds, F.col("score")).otherwise(
        F.raise_error(F.concat(F.lit("unfinished search point: "), F.to_json(F.struct("draw", "model", "point", "n"))))))
    return verify.row_at_max(mean, ["draw", "model"], "score", "point", ["point", "score"])


def best_draws(threats: DataFrame) -> DataFrame:
    """(model, draw, point): per model the draw with the largest event Threat on its
    held-out years (ties: lowest draw; no Threat counts as -1), with its grid point."""
    t = threats.withColumn("threat", F.coalesce("threat", F.lit(-1.0)))
    return verify.row_at_max(t, ["model"], "threat", "draw", ["draw", "point", "threat"])
