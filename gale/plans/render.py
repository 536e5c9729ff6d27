"""Render driver tables into the text layouts the readers parse.

These builders only produce input files (one Spark write each, into a fresh
folder under the shared checkpoint location); the parsing is done by
:mod:`gale.sources`. The round trip (table -> text -> reader) is compared
with SQL on the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gale.plans import views as V
from gale.sources.results import shared_path

HOURS = list(range(-12, 121, 6))


def _by_case(cases: DataFrame, keys: list[str], predictors: list[str]) -> DataFrame:
    """One row per case: an array with the predictors' cells (as text) at each of ``HOURS``, null at hours without a row."""
    cells = F.struct(*[F.col(p).cast("string").alias(p) for p in predictors])
    g = cases.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("TIME", cells))).alias("_at"))
    return g.select(*keys, F.transform(F.array(*[F.lit(h) for h in HOURS]), lambda h: F.col("_at")[h]).alias("_cells"))


def _vals(predictor: str, name: str | None = None, skip: int = 0) -> F.Column:
    """The predictor's line: its cells from step ``skip`` on, then its name."""
    cells = F.col("_cells")[predictor]
    return F.concat_ws(" ", F.array_join(F.slice(cells, skip + 1, len(HOURS) - skip) if skip else cells, " ", "9999"), F.lit(name or predictor))


ODD_NAMES = ("ASTRIDE", "BEAST", "LASTHEAD")  # of the cases with case_id % 7 = 0, 1, 2


def case_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text record per case: header, predictor lines in all four token
    layouts (plain, with age, from hour 0, from hour 0 with age), LAST.

    By line number of the case the files also hold what the reader must cope
    with: indented markers, lines of other lengths, an earlier line of the same
    predictor, a truncated record in front, and marker letters in names of storms
    (``ODD_NAMES``) and of a predictor (``ASTX``, a copy of VMAX)."""
    c = V.cases(spark, sf_dir)
    g = _by_case(c, ["case_id", "storm_id", "NAME", "DATE_full", "YEAR"], ["VMAX", "SHRG", "IR00", "RSST", "PC00"])
    atcf = F.concat(F.lit("AL"), F.lpad(F.col("storm_id").cast("string"), 2, "0"), F.col("YEAR").cast("string"))
    named = F.regexp_replace("NAME", " ", "_")
    for n, odd_name in enumerate(ODD_NAMES):
        named = F.when(F.col("case_id") % 7 == n, odd_name).otherwise(named)
    header = F.concat_ws(" ", named, F.date_format("DATE_full", "yyMMdd"),
                         F.lit("00"), F.lit("45"), F.lit("20.0"), F.lit("60.0"), F.lit("1000"), atcf, F.lit("HEAD"))
    kind = F.col("case_id") % 4
    vmax = _vals("VMAX")
    odd = F.when(kind == 1, F.concat_ws("\n", F.lit("-12 0 6 TIME"), F.lit("ONE"), F.lit("7 7 SHRG"), F.lit("8 8 SHRG"), F.lit("")))
    first = F.when(kind == 2, F.concat(F.regexp_replace(vmax, r"\d+\.\d+", "1.0"), F.lit("\n")))
    cut = F.when(kind == 3, F.concat_ws("\n", header, F.regexp_replace(vmax, r"\d+\.\d+", "2.0"), F.lit("")))
    last = F.when(kind == 0, F.lit("LAST")).otherwise(F.lit("          LAST  "))
    lines = [F.concat(F.coalesce(cut, F.lit("")), header),
             F.concat(F.coalesce(odd, F.lit("")), F.coalesce(first, F.lit("")), vmax),
             _vals("SHRG"),
             _vals("VMAX", "ASTX"),
             F.concat_ws(" ", _vals("RSST"), F.lit("3")),
             _vals("IR00", skip=2),
             F.concat_ws(" ", _vals("PC00", skip=2), F.lit("0")),
             last]
    file = F.concat(F.date_format("DATE_full", "yyMM0100"), F.lit("AL01"), F.date_format("DATE_full", "yy"), F.lit("_lsdiag.dat"))
    return g.select(F.concat_ws("\n", *lines).alias("value"), file.alias("file"))


def write_case_records(spark: SparkSession, sf_dir: str, by_cycle: bool = False) -> str:
    """``by_cycle``: entries named ``YYMMDDHHBBNNYY_lsdiag.dat``, one a month
    (folders of that name, which Spark reads like files)."""
    path = shared_path(spark, "cases-text")
    recs = case_records(spark, sf_dir)
    if not by_cycle:
        recs.select("value").write.text(path)
        return path
    recs.repartition("file", F.xxhash64("value") % 4).write.partitionBy("file").text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(hadoop.Path(path)):
        name = entry.getPath().getName()
        if name.startswith("file="):
            fs.rename(entry.getPath(), hadoop.Path(f"{path}/{name.removeprefix('file=')}"))
    return path


def write_feature_records(spark: SparkSession, sf_dir: str, files: int = 48) -> str:
    """Every predictor of every case as record files; the id token is ``<basin>-<case>``, blanks are ``~``.
    Hours without a source row hold the sentinel in every predictor. The files are packed (gzip): a case is 2 KB of text."""
    g = _by_case(V.cases(spark, sf_dir), ["case_id", "BASIN", "NAME", "DATE_full"], V.PREDICTORS)
    header = F.concat_ws(" ", F.translate("NAME", " ", "~"), F.date_format("DATE_full", "yyMMdd"), F.lit("00 45 20.0 60.0 1000"),
                         F.concat_ws("-", F.translate("BASIN", " ", "~"), F.col("case_id").cast("string")), F.lit("HEAD"))
    path = shared_path(spark, "feature-records")
    lines = F.concat_ws("\n", header, *[_vals(p) for p in V.PREDICTORS], F.lit("LAST"))
    g.select(lines.alias("value")).repartition(files, "value").write.option("compression", "gzip").text(path)
    return path


def write_arrivals(rows: DataFrame, time_col: str, name: str, files: int) -> str:
    """``rows`` as ``files`` files in the order of ``time_col``, which arrive (by modification time) in that order."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, name)
    rows.repartitionByRange(files, time_col).write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s.getPath().getName(), s) for s in fs.listStatus(hadoop.Path(path)) if s.getPath().getName().startswith("part-"))
    first = min((s.getModificationTime() for _, s in found), default=0)
    for i, (_, s) in enumerate(found):
        fs.setTimes(s.getPath(), first - 1000 * (len(found) - i), -1)
    return path


# Stand-in technique codes: event types renamed into the deck's code domain.
TECH_CODES = {"click": "RIOC", "view": "RIOD", "purchase": "LDA0", "signup": "RAPC", "error": "FRIA"}


def _code(tech: F.Column) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in TECH_CODES.items() for x in kv])[tech]


def _route(tech: F.Column) -> F.Column:
    return F.when(tech.isin("click", "view"), "RI").when(tech == "error", "IN").otherwise("RW")


def deck_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability forecasts as comma+space lines (RI/RW: 14 fields, IN: 12)."""
    f = V.forecasts(spark, sf_dir)
    basin = F.element_at(F.array(F.lit("AL"), F.lit("EP"), F.lit("IO")), (F.col("storm_id") % 3 + 1).cast("int"))
    cy = F.format_string("%02d", F.col("storm_id"))
    date = F.date_format("DATE_full", "yyyyMMddHH")
    route = _route(F.col("Tech"))
    change = F.when(F.col("Tech") == "view", F.lit("40")).otherwise(F.lit("30"))
    stop = F.when(F.col("n") > 1, F.lit("48")).otherwise(F.lit("24"))
    code = _code(F.col("Tech"))
    ri = F.concat_ws(", ", basin, cy, date, route, code, F.lit("0"), F.lit("150N"), F.lit("600W"),
                     F.col("prob").cast("string"), change, F.lit("0"), F.lit("ABC"), F.lit("0"), stop)
    inn = F.concat_ws(", ", basin, cy, date, route, code, F.lit("0"), F.lit("150N"), F.lit("600W"),
                      F.col("prob").cast("string"), F.lit("XX"), F.lit("0"), F.col("n").cast("string"))
    return f.select(F.when(route == "IN", inn).otherwise(ri).alias("value"),
                    F.year("DATE_full").alias("year"))


LONG_NAME = 60  # letters that a long folder name adds to a path


def write_deck_lines(spark: SparkSession, sf_dir: str, by_year: bool = False, long_name=None) -> str:
    """``long_name``: years, as a condition, whose files lie in a folder with a long name."""
    path = shared_path(spark, "decks")
    d = deck_lines(spark, sf_dir)
    if long_name is not None:
        for folder, cond in (("s", ~long_name(F.col("year"))), ("l" * LONG_NAME, long_name(F.col("year")))):
            d.where(cond).repartition("year", "value").write.partitionBy("year").text(f"{path}/{folder}")
    elif by_year:
        d.repartition("year", "value").write.partitionBy("year").text(path)
    else:
        d.select("value").write.text(path)
    return path


def track_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-track fixes as short comma+space lines: a 34-kt radius row per
    fix and, for busy slots, an extra 50-kt row."""
    c = V.cycles(spark, sf_dir)
    cy = F.format_string("%02d", F.col("storm_id"))
    date = F.date_format("DATE_full", "yyyyMMddHH")

    def line(rad):
        return F.concat_ws(", ", F.lit("AL"), cy, date, F.lit("03"), F.lit("BEST"), F.lit("0"), F.lit("150N"),
                           F.lit("600W"), F.col("VMAX").cast("string"), F.col("MSLP").cast("string"),
                           F.col("grp"), F.lit(rad))
    rows = c.select(F.explode(F.when(F.col("n") > 1, F.array(line("34"), line("50")))
                              .otherwise(F.array(line("34")))).alias("value"))
    return rows


def write_track_lines(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "btk")
    track_lines(spark, sf_dir).write.text(path)
    return path


def write_factor_files(spark: SparkSession, sf_dir: str) -> str:
    """Factor dictionaries of many names, each a file of several lines."""
    p = V.read_table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    entry = F.concat(F.lit('"'), name, F.lit('": '), F.to_json(F.array(F.col("p_size").cast("string"), "p_brand", "p_type")))
    # 500 parts a file
    files = p.groupBy(F.expr("p_partkey div 500").alias("file")).agg(
        F.concat(F.lit("{\n"), F.array_join(F.collect_list(entry), ",\n"), F.lit("\n}")).alias("value"))
    path = shared_path(spark, "factor-files")
    files.write.partitionBy("file").text(path)
    return path


def write_factor_json(spark: SparkSession, sf_dir: str) -> str:
    """A factor dictionary per line: ``{"<part name>": [size, brand, type]}``."""
    p = V.read_table(spark, sf_dir, "part")
    js = F.to_json(F.create_map(F.col("p_name"), F.array(F.col("p_size").cast("string"), "p_brand", "p_type")))
    path = shared_path(spark, "factors")
    p.select(js.alias("value")).write.text(path)
    return path
