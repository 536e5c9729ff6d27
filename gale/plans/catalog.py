"""Registry of named queries and their DuckDB oracle twins.

A query is ``(spark, sf_dir) -> DataFrame`` built from the package's
operators over the stand-in views. Its twin is plain SQL over the driver
tables (the view definitions are prepended as CTEs), written independently of
the Spark code. Doubles are rounded to a binary grid of 2^-20 (ties to even,
-0 folded into 0) in both so results compare exactly: decimal data never sits
exactly on a binary half-step, so summation-order noise cannot flip a digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gale.plans.views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

GRID = 1048576.0  # 2^20

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
DOCS: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    """Round every double to the 2^-20 grid the way the oracle does."""
    exprs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.rint(c.cast("double") * F.lit(GRID)) / F.lit(GRID) + F.lit(0.0))
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def R(expr: str) -> str:
    """SQL twin of :func:`finish` for one expression."""
    return f"(round_even(CAST({expr} AS DOUBLE) * {GRID!r}, 0) / {GRID!r} + 0.0)"


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Decorator: add a query (and its oracle SQL, if it has one)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            return finish(_fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        DOCS[name] = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
        if sql is not None:
            ORACLE[name] = with_views(sql, *views) if views else sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from gale.plans import (q_explore, q_features, q_ingest, q_models,  # noqa: F401
                            q_reliability, q_series, q_verify, q_streaming)
