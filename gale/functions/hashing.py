"""Deterministic pseudo-random numbers from row keys.

``md5`` of the key text gives a number that is the same in every engine and
independent of partitioning, so splits, folds and draws are reproducible and
checkable against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(*cols: str | Column, seed: str | int | None = None) -> Column:
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    if seed is not None:
        parts = [F.lit(str(seed))] + parts
    return F.concat_ws("|", *parts)


def md5_number(*cols: str | Column, seed: str | int | None = None) -> Column:
    """First 60 bits of md5(key) as a bigint in [0, 2^60)."""
    return F.conv(F.substring(F.md5(key_text(*cols, seed=seed)), 1, 15), 16, 10).cast("bigint")
