"""Intensity classes from a 24-hour change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gale.functions.names import CLASS_LABELS_2, CLASS_LABELS_3, CLASS_LABELS_5, lookup

# --- Fixed values: class edges in knots --------------------------------------
RI_THRESHOLD = 30
MINOR_CHANGE = 10
# ---------------------------------------------------------------------------


def intensity_class(diff: str | Column, n_classes: int = 2,
                    threshold: float = RI_THRESHOLD) -> Column:
    """Class number of a change. A null change compares false -> class 0.

    2 classes: d >= T -> 1.
    5 classes: d >= T -> 2, d <= -T -> -2, 10 <= d < T -> 1, -T < d <= -10 -> -1.
    3 classes: d >= 10 -> 1, d <= -10 -> -1.
    """
    d = F.col(diff) if isinstance(diff, str) else diff
    t = F.lit(threshold)
    m = F.lit(MINOR_CHANGE)
    if n_classes == 2:
        return F.when(d >= t, 1).otherwise(0)
    if n_classes == 5:
        return (F.when(d >= t, 2).when(d <= -t, -2)
                .when((d >= m) & (d < t), 1).when((d > -t) & (d <= -m), -1).otherwise(0))
    if n_classes == 3:
        return F.when(d >= m, 1).when(d <= -m, -1).otherwise(0)
    raise ValueError("n_classes must be 2, 3 or 5")


def class_label(cls: str | Column, n_classes: int = 2) -> Column:
    """Class number -> label text."""
    mapping = {2: CLASS_LABELS_2, 3: CLASS_LABELS_3, 5: CLASS_LABELS_5}[n_classes]
    return lookup(F.col(cls) if isinstance(cls, str) else cls, mapping, keep_unmatched=False)
