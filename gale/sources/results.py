"""Processed tables and result sinks.

Results are written as parquet partitioned by the columns readers filter on
(model, basin, year), so later reads prune partitions; run parameters are
columns, not file names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gale.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/gale-io/{name}-{uuid.uuid4().hex[:12]}"


def write_results(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> str:
    """Write a result table as parquet, partitioned for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def load_processed(spark: SparkSession, path: str, *, basin: str = "ALL",
                   years: tuple[int, int] | None = None, basin_col: str = "BASIN",
                   year_col: str = "YEAR", merge: dict[str, str] | None = None) -> DataFrame:
    """One partitioned read instead of one file per basin; the basin and
    year filters prune partitions. ``merge`` renames columns (e.g. RSST ->
    NSST) where present."""
    df = spark.read.parquet(path)
    if basin != "ALL":
        df = df.where(F.col(basin_col) == basin)
    if years:
        df = df.where(F.col(year_col).between(*years))
    for a, b in (merge or {}).items():
        if a in df.columns and b not in df.columns:
            df = df.withColumnRenamed(a, b)
    return df


def load_csv(spark: SparkSession, paths, schema: str, *, drop: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a fixed schema (no inference), index columns dropped."""
    df = spark.read.option("header", "true").schema(schema).csv(paths)
    return df.drop(*[c for c in drop if c in df.columns])


def reload_results(spark: SparkSession, path: str) -> DataFrame:
    """Re-read a written result table."""
    return spark.read.parquet(path)
