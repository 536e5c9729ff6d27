"""Training, prediction and model evaluation with ``pyspark.ml``.

Training runs on executors (tree building and L-BFGS are distributed by
``pyspark.ml``); the driver only loops over the fold and grid settings and
holds model parameters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gale.functions.hashing import md5_number
from gale.operators.scan import with_position
from gale.operators.sampling import HASH_BUCKET, stratified_folds
from gale.session import materialize

# --- Fixed values: reference search grids -------------------------------------
RF_MAX_DEPTH = [5, 6, 8, 11]
RF_MAX_FEATURES = [4, 5]
RF_TREES = 250
RF_MIN_LEAF = 10
LR_C = [0.01, 0.1, 1.0, 10.0, 100.0]
LR_MAX_ITER = [100, 1000, 10000]
# ---------------------------------------------------------------------------


def _pipeline(features: list[str], clf, scale: bool) -> Pipeline:
    """A null feature is an error here: drop such rows on purpose, with
    ``clean.drop_null_rows``, before training or predicting."""
    st = [VectorAssembler(inputCols=features, outputCol="_raw" if scale else "features", handleInvalid="error")]
    if scale:
        st.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=st + [clf])


def logistic_grid(c_values=LR_C, max_iter=LR_MAX_ITER) -> list[dict]:
    """The logistic grid (C x maximum iterations)."""
    return [{"C": float(c), "maxIter": int(m)} for c in c_values for m in max_iter]


def forest_grid(depths=RF_MAX_DEPTH, max_features=RF_MAX_FEATURES) -> list[dict]:
    """M9: the forest grid (depth x features per split)."""
    return [{"maxDepth": int(d), "maxFeatures": int(m)} for d in depths for m in max_features]


def fit_logistic(train: DataFrame, features: list[str], label: str, params: dict, *,
                 weight_col: str | None = None, l1: bool = False) -> PipelineModel:
    """One logistic fit. Spark's regParam is 1 / (C * sum of weights) of
    the very rows the model is fitted on."""
    total = train.agg(F.sum(weight_col) if weight_col else F.count(F.lit(1))).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol=label, standardization=False,
                            elasticNetParam=1.0 if l1 else 0.0, maxIter=params["maxIter"],
                            regParam=1.0 / (params["C"] * float(total)))
    if weight_col:
        lr.setWeightCol(weight_col)
    return _pipeline(features, lr, True).fit(train)


def fit_forest(train: DataFrame, features: list[str], label: str, params: dict, *, weight_col: str | None = None,
               trees: int = RF_TREES, min_leaf: int = RF_MIN_LEAF, seed: int = 0) -> PipelineModel:
    """M9: one forest fit."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, minInstancesPerNode=min_leaf,
                                maxDepth=params["maxDepth"], featureSubsetStrategy=str(params["maxFeatures"]), seed=seed)
    if weight_col:
        rf.setWeightCol(weight_col)
    return _pipeline(features, rf, False).fit(train)


def dealt_folds(train: DataFrame, key: str, class_col: str, *, k: int = 10, repeats: int = 3, seed: int = 0) -> Iterator[DataFrame]:
    """M8: per repeat the rows with their ``fold``, materialized; raises when a fold or the
    rest of the rows has not every class."""
    for r in range(repeats):
        folded = materialize(stratified_folds(train, key, class_col, k, repeat=r, seed=seed))
        have = {(x["fold"], x[class_col]): x["count"] for x in folded.groupBy("fold", class_col).count().collect()}
        classes = {c for _, c in have}
        if len(classes) < 2 or any((f, c) not in have for f in range(k) for c in classes):
            raise ValueError(f"{k} folds need rows of two classes each: {have}")
        yield folded


def fold_parts(folds: Iterable[DataFrame], k: int, prepare) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Per fold of each repeat: the prepared training part, materialized, and the held-out part as it is."""
    for folded in folds:
        for f in range(k):
            yield materialize(prepare(folded.where(F.col("fold") != f).drop("fold"))), folded.where(F.col("fold") == f)


def grid_search(train: DataFrame, grid: list[dict], fit, key: str, class_col: str, label: str, *, k: int = 10,
                repeats: int = 3, prepare=None, seed: int = 0, parallelism: int = 4,
                parts: Iterable[tuple[DataFrame, DataFrame]] | None = None,
                whole: DataFrame | None = None) -> tuple[PipelineModel, dict, float]:
    """Repeated stratified k-fold search by weighted F1, then a refit of
    the best grid point (ties: the first) on all rows.

    ``prepare`` (resampling, class weights) is applied to the training part of
    each fold only; the held-out part is scored as it is. ``fit(rows, params)``
    returns a model. Returns model, parameters and mean score; raises when a
    fold or the training part of one has a single class. Searches over the same folds may
    share what :func:`fold_parts` made of them (``parts``) and the prepared rows of the
    refit (``whole``)."""
    prepare = prepare or (lambda df: df)
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="weightedFMeasure")
    scores = [[] for _ in grid]
    if parts is None:
        parts = fold_parts(dealt_folds(train, key, class_col, k=k, repeats=repeats, seed=seed), k, prepare)
    for part, held in parts:
        with ThreadPool(parallelism) as pool:
            found = pool.map(lambda p: ev.evaluate(fit(part, p).transform(held)), grid)
        for i, s in enumerate(found):
            scores[i].append(s)
    mean = [sum(s) / len(s) for s in scores]
    best = max(range(len(grid)), key=lambda i: (mean[i], -i))
    return fit(materialize(prepare(train)) if whole is None else whole, grid[best]), grid[best], mean[best]


def predict(model, df: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """Predicted class and both class probabilities with truth."""
    out = model.transform(df)
    p = vector_to_array("probability")
    return out.select(*keys, F.col(label).alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
                      p[0].alias("p0"), p[1].alias("p1"), F.lit(name).alias("Model"))


def weighted_f1(counts: DataFrame, group_cols: list[str], out_col: str) -> DataFrame:
    """F1 per class weighted by the class's rows, from (group, y, y_hat, n) counts."""
    n = F.col("n")
    per = counts.select(*group_cols, F.explode(F.array("y", "y_hat")).alias("c")).distinct()
    rows = per.join(counts, group_cols).groupBy(*group_cols, "c").agg(
        F.sum(F.when((F.col("y") == F.col("c")) & (F.col("y_hat") == F.col("c")), n).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("y") == F.col("c"), n).otherwise(0)).alias("na"),
        F.sum(F.when(F.col("y_hat") == F.col("c"), n).otherwise(0)).alias("np"))
    f1 = F.col("na") * 2 * F.col("tp") / (F.col("na") + F.col("np"))
    return rows.groupBy(*group_cols).agg((F.sum(f1) / F.sum("na")).alias(out_col))


# Multipliers of the permutations: the first that shares no factor with a scope's number of rows is used.
MULTIPLIERS = [1_000_003, 2_147_483_647, 998_244_353, 1_000_000_007]


def dealt_position(position: Column, n: Column, copy: Column, seed: int) -> Column:
    """A bijection of 1..n, another for each ``copy``: a * p + b modulo n, with b drawn
    from md5 and a prime a that does not divide n (n < 2^31, else a = 1)."""
    a = F.coalesce(*[F.when((n < 2 ** 31) & ((n % m) != 0), F.lit(m) % n) for m in MULTIPLIERS], F.lit(1))
    b = md5_number(copy, seed=f"deal{seed}") % n
    return F.pmod(a * (position - 1) + b, n) + 1


def permutation_importance(model, df: DataFrame, keys: list[str], features: list[str], label: str,
                           repeats: int = 3, seed: int = 0, scope_col: str | None = None) -> DataFrame:
    """Mean and std of the drop in weighted F1 when one feature is
    shuffled, per value of ``scope_col`` and for ALL rows.

    Rows are numbered once per scope in md5 order (the distributed scan). In copy
    (feature, repeat) the row at position p takes the feature value of the row at a
    position that a bijection of 1..n gives, so a column's values are dealt anew and the
    other columns stay. Only (position, copy, value) moves: the dealt values of all
    copies are gathered per row, joined to it once, and the copies are made, scored
    and counted where the row is."""
    scoped = df.withColumn("_scope", F.lit("ALL"))
    if scope_col:
        scoped = scoped.unionByName(df.withColumn("_scope", F.col(scope_col).cast("string")))
    hit = [F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("y_hat")]

    def score(rows: DataFrame, group: list[str], out_col: str) -> DataFrame:
        counts = model.transform(rows).groupBy(*group, *hit).agg(F.count(F.lit(1)).alias("n"))
        return weighted_f1(counts, group, out_col)
    base = score(scoped, ["_scope"], "base")
    placed = materialize(with_position(scoped.withColumn("_h", md5_number(*keys, "_scope", seed=seed)), ["_scope"],
                                       ["_h"] + keys, position_col="_p", bucket_width=HASH_BUCKET).drop("_h"))
    sizes = placed.groupBy("_scope").agg(F.count(F.lit(1)).alias("_n"))
    moved = dealt_values(placed, sizes, features, repeats, seed)
    rows = placed.join(moved, ["_scope", "_p"]).withColumn("_e", F.explode("_dealt")) \
        .select("*", "_e._feature", "_e._rep", "_e._v").drop("_e", "_dealt")
    dealt = rows.withColumns({f: F.when(F.col("_feature") == f, F.col("_v")).otherwise(F.col(f)) for f in features})
    drop = score(dealt.drop("_v", "_p"), ["_scope", "_feature", "_rep"], "f1").join(base, "_scope") \
        .withColumn("drop", F.col("base") - F.col("f1"))
    return drop.groupBy(F.col("_scope").alias("scope"), F.col("_feature").alias("feature")).agg(
        F.avg("drop").alias("mean_importance"), F.stddev_pop("drop").alias("std_importance"))


def dealt_values(placed: DataFrame, sizes: DataFrame, features: list[str], repeats: int, seed: int) -> DataFrame:
    """(_scope, _p, _dealt): for every row the values that each (feature, repeat) copy deals it."""
    copies = F.explode(F.array(*[F.struct(F.lit(f).alias("_feature"), F.lit(r).alias("_rep"), F.col(f).cast("double").alias("_v"))
                                 for f in features for r in range(repeats)]))
    giver = placed.join(sizes, "_scope").select("_scope", "_p", "_n", copies.alias("e"))
    to = dealt_position(F.col("_p"), F.col("_n"), F.concat_ws("|", "_scope", "e._feature", F.col("e._rep").cast("string")), seed)
    return giver.select("_scope", to.alias("_p"), "e").groupBy("_scope", "_p").agg(F.collect_list("e").alias("_dealt"))


def save_model(model, path: str) -> str:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Load a fitted pipeline."""
    return PipelineModel.load(path)
