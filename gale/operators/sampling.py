"""Resampling and splits.

Every draw is a deterministic function of ``md5(seed | key)`` (see
:mod:`gale.functions.hashing`), so results do not depend on partitioning and
can be reproduced in SQL. Ranks inside a class use the distributed scan: a
class is a hot key by construction (two classes hold all rows).
"""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gale.functions.hashing import md5_number
from gale.operators.neighbours import nearest_neighbours
from gale.operators.scan import with_position
from gale.session import materialize

# Grid over the 60-bit hash for ranks inside a class (a class may hold half
# of all rows): 2^20 cells, so each window task sees ~1e-6 of the class.
HASH_BUCKET = float(2 ** 60) / 2 ** 20


def year_draws(df: DataFrame, year_col: str, n_draws: int, k: int, seed: int = 0) -> DataFrame:
    """M1: ``n_draws`` draws of ``k`` held-out years without replacement, from
    the years present in the data: rows ``(draw, year)``. The draw table has
    draws x distinct years rows."""
    years = df.select(F.col(year_col).alias("year")).distinct()
    d = years.select("year", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
    d = d.withColumn("_h", md5_number("draw", "year", seed=seed))
    pos = with_position(d, ["draw"], ["_h", "year"], position_col="_r", bucket_width=HASH_BUCKET)
    return pos.where(F.col("_r") <= k).select("draw", "year")


def stratified_folds(df: DataFrame, key: str, class_col: str, k: int = 10, repeat: int = 0,
                     seed: int = 0, out_col: str = "fold") -> DataFrame:
    """M8: folds that split every class evenly (sizes differ by at most one
    per class): rank inside the class by md5(seed|repeat|key), fold = rank mod
    k. Repeats use a different seed string."""
    h = md5_number(key, seed=f"{seed}|{repeat}")
    x = df.withColumn("_h", h)
    pos = with_position(x, [class_col], ["_h", key], position_col="_r", bucket_width=HASH_BUCKET)
    return pos.withColumn(out_col, ((F.col("_r") - 1) % k).cast("int")).drop("_h", "_r")


MAX_CLASSES = 1000


def class_counts(df: DataFrame, class_col: str) -> dict:
    """Number of rows per class: at most MAX_CLASSES rows, more is an error (the column is no class)."""
    found = df.groupBy(class_col).count().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{class_col} has more than {MAX_CLASSES} values: not a class")
    return {r[0]: r[1] for r in found}


def balanced_weights(df: DataFrame, class_col: str, out_col: str = "weight") -> DataFrame:
    """M3: scikit-learn's 'balanced' weight n / (k * n_c) as a column."""
    counts = materialize(df.groupBy(F.col(class_col).alias("_class")).agg(F.count(F.lit(1)).alias("_nc")))
    n, k = counts.agg(F.sum("_nc"), F.count(F.lit(1))).first()  # two numbers
    w = counts.select("_class", (F.lit(float(n or 0)) / (F.lit(k) * F.col("_nc"))).alias(out_col))
    if k <= MAX_CLASSES:  # a join by shuffle would send a class, and so most rows, to one task
        w = F.broadcast(w)
    return df.join(w, df[class_col].eqNullSafe(w["_class"])).drop("_class")


def random_oversample(df: DataFrame, key: str, class_col: str, minority, ratio: float = 0.7,
                      seed: int = 0) -> DataFrame:
    """M4: append minority rows drawn with replacement until the minority
    has exactly floor(ratio * majority) rows. Draw j takes the minority row at
    position 1 + md5(seed|j) mod n_min; positions come from the distributed
    scan, the draws are an equi-join on position (a row may be drawn more
    than once, as with replacement)."""
    counts = class_counts(df, class_col)
    n_min = counts.get(minority, 0)
    n_maj = max(v for c, v in counts.items() if c != minority)
    extra = int(ratio * n_maj) - n_min
    if extra <= 0 or n_min == 0:
        return df
    mino = df.where(F.col(class_col) == minority).withColumn("_h", md5_number(key, seed=seed))
    pos = with_position(mino, [], ["_h", key], position_col="_p", bucket_width=HASH_BUCKET).drop("_h")
    spark = df.sparkSession
    draws = spark.range(extra).select(
        (md5_number("id", seed=f"os{seed}") % n_min + 1).alias("_p"))
    added = draws.join(pos, "_p").drop("_p")
    return df.unionByName(added.select(*df.columns))


def smote(df: DataFrame, key: str, class_col: str, minority, features: list[str], ratio: float = 0.7,
          k: int = 5, seed: int = 0, cap: int = 2048) -> DataFrame:
    """M5: append synthetic minority rows until the minority has exactly
    floor(ratio * majority) rows (counted among rows without a null or NaN feature,
    which stay as they are). Draw j takes the minority row at position
    1 + md5(seed|j) mod n_min, one of its exact k nearest minority neighbours and a
    gap in [0, 1): its features are x + gap * (neighbour - x), its other columns the
    row's. A minority of one row has no neighbours and is left as it is."""
    value = {f: F.col(f).cast("double") for f in features}
    whole = ~F.exists(F.array(*value.values()), lambda v: v.isNull() | F.isnan(v))
    counts = class_counts(df.where(whole), class_col)
    n_min = counts.get(minority, 0)
    extra = int(ratio * max((v for c, v in counts.items() if c != minority), default=0)) - n_min
    if extra <= 0 or n_min < 2:
        return df
    mino = materialize(df.where(whole & (F.col(class_col) == minority)))
    near = nearest_neighbours(mino, key, features, k, cap).groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))), lambda e: e["neighbour"]).alias("_near"))
    pos = with_position(mino.withColumn("_h", md5_number(key, seed=seed)), [], ["_h", key], position_col="_p",
                        bucket_width=HASH_BUCKET).drop("_h").join(near, key)
    draws = df.sparkSession.range(extra).select(
        (md5_number("id", seed=f"sm{seed}") % n_min + 1).alias("_p"), md5_number("id", seed=f"nn{seed}").alias("_n"),
        (md5_number("id", seed=f"gap{seed}").cast("double") / float(2 ** 60)).alias("_gap"))
    base = draws.join(pos, "_p").withColumn("_other", F.element_at("_near", (F.col("_n") % F.size("_near") + 1).cast("int")))
    other = mino.select(F.col(key).alias("_other"), *[value[f].alias(f"_to_{f}") for f in features])
    made = base.join(other, "_other").withColumns({f: value[f] + F.col("_gap") * (F.col(f"_to_{f}") - value[f]) for f in features})
    return df.withColumns(value).unionByName(made.select(*df.columns))


def random_undersample(df: DataFrame, key: str, class_col: str, minority, seed: int = 0) -> DataFrame:
    """M6: keep every minority row and as many rows of each other class
    (lowest md5 ranks)."""
    n_min = class_counts(df, class_col).get(minority, 0)
    if n_min == 0:  # nothing to balance against
        return df
    x = df.withColumn("_h", md5_number(key, seed=seed))
    pos = with_position(x, [class_col], ["_h", key], position_col="_r", bucket_width=HASH_BUCKET)
    keep = (F.col(class_col) == minority) | (F.col("_r") <= n_min)
    return pos.where(keep).drop("_h", "_r")


def shuffle_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A reproducible permutation (order by md5 of the key)."""
    return df.orderBy(md5_number(key, seed=seed), key)


def standardise_features(df: DataFrame, cols: list[str], out_col: str = "features") -> DataFrame:
    """M7: StandardScaler (mean and sample std) fitted on ``df``."""
    v = VectorAssembler(inputCols=cols, outputCol="_raw").transform(df)
    model = StandardScaler(inputCol="_raw", outputCol=out_col, withMean=True, withStd=True).fit(v)
    return model.transform(v).drop("_raw")
