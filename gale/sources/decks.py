"""Comma-separated forecast and track decks.

Lines are read with the text source and split on ``,\\s*`` in the JVM; a
record type is routed with a filter on one field, and missing trailing
fields of short lines come back as null (``get`` beyond the array end).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: deck layouts ------------------------------------------------
RI_COLUMNS = ["BASIN", "CYCLONE NO", "DATE", "ProbFormat", "Tech", "TAU", "LAT", "LON",
              "ProbItem", "Intensity Change", "V", "Initials", "RIstartTAU", "RIstopTAU"]
IN_COLUMNS = ["BASIN", "CYCLONE NO", "DATE", "ProbFormat", "Tech", "TAU", "LAT", "LON",
              "ProbItem", "TY", "foo", "HalfRange"]
RI_COLUMNS_2019 = ["BASIN", "Cyclone No", "Date", "Format", "Technique", "TAU", "Lat", "Lon",
                   "Probability", "d_I", "V", "Initials", "RI start", "RI end"]
TRACK_COLUMNS = ["BASIN", "CYCLONE NO", "DATE", "TECHNUM", "TECH", "TAU", "LAT", "LON", "VMAX",
                 "MSLP", "TYPE", "RAD", "WINDCODE", "RAD1", "RAD2", "RAD3", "RAD4", "P Outer",
                 "R Outer", "RMW", "GUSTS", "EYE", "SUBREGION", "MAXSEAS", "INITIALS", "DIR",
                 "SPEED", "NAME", "DEPTH", "SEAS", "SEASCODE", "SEAS1", "SEAS2", "SEAS3", "SEAS4"]
ROUTES = ("RI", "IN", "RW")
# ---------------------------------------------------------------------------


def _fields(spark: SparkSession, paths, *, max_path_len: int | None = None) -> DataFrame:
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_path"))
    if max_path_len is not None:
        raw = raw.where(F.length("_path") <= max_path_len)
    f = F.split(F.regexp_replace(F.trim(F.col("value")), r",\s*$", ""), r",\s*")
    return raw.select(f.alias("f"), "_path").where(F.size("f") > 1)


def _typed(f: DataFrame, columns: list[str]) -> DataFrame:
    return f.select(*[F.get(F.col("f"), i).alias(c) for i, c in enumerate(columns)], "_path")


def ingest_prob_forecasts(spark: SparkSession, paths, route: str = "RI") -> DataFrame:
    """S3: one record type (RI, IN or RW, the 4th field) with its layout."""
    f = _fields(spark, paths)
    f = f.where(F.get(F.col("f"), 3) == route)
    return _typed(f, IN_COLUMNS if route == "IN" else RI_COLUMNS).drop("_path")


def ingest_prob_forecasts_v2019(spark: SparkSession, paths) -> DataFrame:
    """The older 14-column layout with an ATCF id (basin+number+year)."""
    f = _typed(_fields(spark, paths), RI_COLUMNS_2019).drop("_path")
    year = F.substring(F.col("Date"), 1, 4)
    return f.withColumn("ATCFID", F.concat(F.col("BASIN"), F.col("Cyclone No"), year))


def ingest_prob_forecasts_multi_year(spark: SparkSession, paths: list[str], *,
                                     max_path_len: int | None = None) -> DataFrame:
    """Several years at once (path globs); long paths can be excluded;
    RI and RW records; YEAR and ATCFID added."""
    f = _fields(spark, paths, max_path_len=max_path_len)
    f = f.where(F.get(F.col("f"), 3).isin("RI", "RW"))
    t = _typed(f, RI_COLUMNS).drop("_path")
    year = F.substring(F.col("DATE"), 1, 4)
    return t.withColumns({"YEAR": year.try_cast("int"),
                          "ATCFID": F.concat(F.col("BASIN"), F.col("CYCLONE NO"), year)})


def ingest_best_track(spark: SparkSession, paths) -> DataFrame:
    """35-column track; short lines are null-padded; ATCF id and hour."""
    t = _typed(_fields(spark, paths), TRACK_COLUMNS).drop("_path")
    ts = F.to_timestamp_ntz(F.col("DATE"), F.lit("yyyyMMddHH"))
    return t.withColumns({
        "ATCFID": F.concat(F.col("BASIN"), F.col("CYCLONE NO"), F.substring("DATE", 1, 4)),
        "DATE_full": ts, "HOUR": F.hour(ts)})
