"""Fixed-layout forecast diagnostics (S1, S2) and the factor dictionary.

A case record is a header line whose last token is ``HEAD``, one line per
predictor and a closing line whose last token is ``LAST``, indented or not.
:mod:`gale.sources.records` reads them, one row per record, from byte ranges of
the files; here each record becomes 23 rows (forecast hours -12..120) by
exploding a position array next to the value arrays, so the reshape to a table
of hours needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gale.sources.records import N_STEPS, SPLIT_BYTES, case_records

# --- Fixed values: forecast hours and two-digit years --------------------------
FIRST_HOUR = -12
STEP_HOURS = 6
CENTURY_PIVOT = 69      # two-digit years 69..99 -> 19xx, 00..68 -> 20xx
# ---------------------------------------------------------------------------


def parse_issue_time(yymmdd: Column, hh: Column) -> Column:
    """``yyMMdd`` + hour with Python's two-digit-year pivot."""
    yy = F.substring(yymmdd, 1, 2).try_cast("int")
    year = F.when(yy >= CENTURY_PIVOT, yy + 1900).otherwise(yy + 2000)
    return F.make_timestamp_ntz(year, F.substring(yymmdd, 3, 2).try_cast("int"),
                                F.substring(yymmdd, 5, 2).try_cast("int"), hh.try_cast("int"),
                                F.lit(0), F.lit(0))


def hourly_rows(records: DataFrame, predictors: list[str], ages: list[str] | None = None) -> DataFrame:
    """Records (:func:`gale.sources.records.case_records`) -> one row per forecast hour."""
    rec = records.select(F.col("atcf_id").alias("ATCFID"), F.col("name").alias("NAME"),
                         parse_issue_time(F.col("yymmdd"), F.col("hh")).alias("DATE_full"),
                         *predictors, *[f"{p}_AGE" for p in (ages or [])])
    rows = rec.select("*", F.explode(F.sequence(F.lit(0), F.lit(N_STEPS - 1))).alias("__i"))
    cols = [F.nullif(F.try_element_at(p, F.col("__i") + 1), F.lit("")).alias(p) for p in predictors]
    return rows.select("ATCFID", "NAME", "DATE_full",
                       (F.lit(FIRST_HOUR) + F.col("__i") * STEP_HOURS).cast("int").alias("TIME"), *cols,
                       *[f"{p}_AGE" for p in (ages or [])])


def ingest_case_diagnostics(spark: SparkSession, paths: str | list[str], predictors: list[str], *,
                            with_age: list[str] | None = None, path_glob: str | None = None,
                            split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(ATCFID, NAME, DATE_full, TIME, <predictors> as string, <p>_AGE)``.

    Values stay strings here (``try_cast`` in P3 turns bad text into null);
    ``with_age`` lists predictors whose age token becomes ``<p>_AGE``. LF and
    CRLF files, indented markers and a byte-order mark are read alike. Lines
    that have neither a marker nor 22 to 25 tokens are skipped; of lines with
    the same predictor name the last one counts; the last header before the
    marker counts; records without header or without ``LAST`` are dropped."""
    records = case_records(spark, paths, predictors, ages=with_age, path_glob=path_glob, split_bytes=split_bytes)
    return hourly_rows(records, predictors, with_age)


def scan_cycle_files(spark: SparkSession, root: str, prefix: str, *, predictors: list[str],
                     with_age: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Read only the files ``YYMMDDHHBBNNYY_lsdiag.dat`` whose name starts
    with ``prefix`` (``YYMMDDHHBB`` or less of it); the glob prunes files
    before any task starts."""
    return ingest_case_diagnostics(spark, f"{root.rstrip('/')}/{prefix}*_lsdiag.dat", predictors,
                                   with_age=with_age, split_bytes=split_bytes)


def load_scale_factors(spark: SparkSession, path: str, *, json_lines: bool = False) -> DataFrame:
    """JSON object ``{name: [factor, unit, description]}`` -> rows
    ``(name, factor, unit, descr)``; one object per file, or one per line
    with ``json_lines``. The dictionary is small and fixed; the result is
    meant to be broadcast (J8)."""
    txt = spark.read.text(path, wholetext=not json_lines)
    m = F.from_json(F.col("value"), "map<string, array<string>>")
    e = txt.select(F.explode(m).alias("name", "v"))
    return e.select("name", F.element_at("v", 1).try_cast("double").alias("factor"),
                    F.element_at("v", 2).alias("unit"), F.element_at("v", 3).alias("descr"))
