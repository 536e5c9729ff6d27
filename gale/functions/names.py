"""Name lookups as literal map columns.

Each lookup is a ``create_map`` literal applied with ``coalesce`` so values
without an entry pass through unchanged; the expression stays inside
whole-stage codegen.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values (must equal the reference's for matching results) ---------
# Two-letter ATCF basin code -> basin name used in the tables.
BASIN_LONG_NAMES = {
    "AL": "ATLANTIC",
    "EP": "EAST_PACIFIC",
    "CP": "CENTRAL_PACIFIC",
    "WP": "WEST_PACIFIC",
    "SH": "SOUTHERN_HEM",
    "IO": "INDIAN_OCEAN",
}
# Basin name -> two-letter code (reliability tables).
BASIN_CODES = {
    "ATLANTIC": "AL",
    "EAST_PACIFIC": "EP",
    "WEST_PACIFIC": "WP",
    "SOUTHERN_HEM": "SH",
}
# Basin merges applied before training and in the reliability tables.
BASIN_MERGES = {
    "CENTRAL_PACIFIC": "EAST_PACIFIC",
    "SOUTH_PACIFIC": "SOUTHERN_HEM",
}
# Basins whose ocean predictors are NSST/NOHC; others report RSST/RHCN.
NSST_BASINS = ["ATLANTIC", "EAST_PACIFIC", "CENTRAL_PACIFIC"]
# Technique code -> product name in the reliability tables.
TECHNIQUE_NAMES = {
    "RIOC": "OP-CON",
    "RIOD": "SHIPS-RII",
    "LDA0": "RIPA",
    "RAPC": "RIPA",
}
# Older (2019) technique names.
TECHNIQUE_NAMES_2019 = {
    "RIOC": "Consensus",
    "RIOL": "RII",
}
# Model renames in the reliability tables.
MODEL_NAMES = {
    "lbfgs": "Logistic Reg.",
}
# Class number -> label, two-class and five-class schemes.
CLASS_LABELS_2 = {1: "RI", 0: "no RI"}
CLASS_LABELS_5 = {2: "RI", 1: "I", 0: "SS", -1: "W", -2: "RW"}
CLASS_LABELS_3 = {1: "I", 0: "SS", -1: "W"}
# ---------------------------------------------------------------------------


def lookup(c: str | Column, mapping: dict, keep_unmatched: bool = True) -> Column:
    """Map ``c`` through ``mapping``; unmatched values pass through (or null)."""
    c = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    hit = m[c]
    return F.coalesce(hit, c) if keep_unmatched else hit


def basin_long_name(code: str | Column, merge_central: bool = False) -> Column:
    """ATCF code -> basin name; optionally CP merged into EP."""
    out = lookup(code, BASIN_LONG_NAMES)
    return lookup(out, BASIN_MERGES) if merge_central else out


def technique_name(c: str | Column, older: bool = False) -> Column:
    """Technique code -> product name."""
    return lookup(c, TECHNIQUE_NAMES_2019 if older else TECHNIQUE_NAMES)


def basin_code(name: str | Column) -> Column:
    """Basin name -> two-letter code, merged basins under their partner's."""
    return lookup(lookup(name, BASIN_MERGES), BASIN_CODES)


def model_name(c: str | Column) -> Column:
    """Model renames of the reliability tables."""
    return lookup(c, MODEL_NAMES)
