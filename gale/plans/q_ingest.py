"""Ingest round trips (S1-S11, S13) and deck cleaning.

Each query renders a driver table into the reference's text layout (a
Spark write to the shared folder), parses it back with the library's reader
and returns the parsed rows; the SQL twin reads the source table directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gale.functions.names import basin_long_name, model_name, technique_name
from gale.operators import clean, series
from gale.plans import render
from gale.plans import views as V
from gale.plans.catalog import R, register
from gale.sources import decks, diagnostics, results

# every case has all 23 hours, those without a source row hold the sentinel
_S1_OUT_SQL = f"""
SELECT 'AL' || lpad(CAST(k.storm_id AS VARCHAR), 2, '0') || CAST(k.YEAR AS VARCHAR) AS ATCFID,
       CASE k.case_id % 7 {' '.join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(render.ODD_NAMES))}
         ELSE replace(k.NAME, ' ', '_') END AS NAME, k.DATE_full, CAST(t.TIME AS INTEGER) AS TIME, {R('c.VMAX')} AS VMAX, {R('c.VMAX')} AS ASTX,
       {R('nullif(c.SHRG, 9999)')} AS SHRG, {R('CASE WHEN t.TIME >= 0 THEN nullif(c.IR00, 9999) END')} AS IR00,
       {R('c.RSST')} AS RSST, {R('CASE WHEN t.TIME >= 0 THEN nullif(c.PC00, 9999) END')} AS PC00,
       '3' AS RSST_AGE, '0' AS PC00_AGE
FROM (SELECT DISTINCT case_id, storm_id, NAME, DATE_full, YEAR FROM cases) k
CROSS JOIN (SELECT unnest(range(-12, 121, 6)) AS TIME) t
LEFT JOIN cases c ON c.case_id = k.case_id AND c.TIME = t.TIME
"""


def _s1_out(df):
    num = ["VMAX", "ASTX", "SHRG", "IR00", "RSST", "PC00"]
    x = df.withColumns({c: F.col(c).try_cast("double") for c in num})
    x = clean.sentinel_to_null(x, num)
    return x.select("ATCFID", "NAME", "DATE_full", "TIME", *num, "RSST_AGE", "PC00_AGE")


@register("ingest_case_diagnostics", _S1_OUT_SQL, ("cases",))
def q_ingest_case_diagnostics(spark, sf_dir):
    """HEAD...LAST records (four token layouts, ages) parsed into hours."""
    path = render.write_case_records(spark, sf_dir)
    df = diagnostics.ingest_case_diagnostics(spark, path, ["VMAX", "ASTX", "SHRG", "RSST", "IR00", "PC00"],
                                             with_age=["RSST", "PC00"])
    return _s1_out(df)


@register("scan_cycle_files", _S1_OUT_SQL + "WHERE strftime(k.DATE_full, '%y%m') = '9603'", ("cases",))
def q_scan_cycle_files(spark, sf_dir):
    """Only the cycle files of one prefix (March 1996) are read."""
    path = render.write_case_records(spark, sf_dir, by_cycle=True)
    df = diagnostics.scan_cycle_files(spark, path, "9603", predictors=["VMAX", "ASTX", "SHRG", "RSST", "IR00", "PC00"],
                                      with_age=["RSST", "PC00"])
    return _s1_out(df)


_ROUTE_SQL = "CASE WHEN Tech IN ('click', 'view') THEN 'RI' WHEN Tech = 'error' THEN 'IN' ELSE 'RW' END"
_BASIN_SQL = "CASE storm_id % 3 WHEN 0 THEN 'AL' WHEN 1 THEN 'EP' ELSE 'IO' END"
_CODE_SQL = ("CASE Tech WHEN 'click' THEN 'RIOC' WHEN 'view' THEN 'RIOD' WHEN 'purchase' THEN 'LDA0' "
             "WHEN 'signup' THEN 'RAPC' ELSE 'FRIA' END")
_NAME_SQL = ("CASE Tech WHEN 'click' THEN 'OP-CON' WHEN 'view' THEN 'SHIPS-RII' WHEN 'purchase' THEN 'RIPA' "
             "WHEN 'signup' THEN 'RIPA' ELSE 'FRIA' END")


def _ri(spark, sf_dir, route="RI"):
    return decks.ingest_prob_forecasts(spark, render.write_deck_lines(spark, sf_dir), route)


@register("ingest_prob_forecasts", f"""
SELECT CASE {_BASIN_SQL} WHEN 'AL' THEN 'ATLANTIC' WHEN 'EP' THEN 'EAST_PACIFIC' ELSE 'INDIAN_OCEAN' END AS BASIN,
       {_BASIN_SQL} || lpad(CAST(storm_id AS VARCHAR), 2, '0') || CAST(year(DATE_full) AS VARCHAR) AS ATCFID,
       DATE_full, {_NAME_SQL} AS Tech, {R('prob')} AS ProbItem,
       CASE WHEN Tech = 'view' THEN 40 ELSE 30 END AS "Intensity Change",
       CASE WHEN n > 1 THEN 48 ELSE 24 END AS RIstopTAU
FROM forecasts WHERE Tech IN ('click', 'view')
""", ("forecasts",))
def q_ingest_prob_forecasts(spark, sf_dir):
    """S3 + P12 + P13 + P14: RI records routed, typed, basin and technique
    named, ATCF id built."""
    ri = _ri(spark, sf_dir)
    ts = F.to_timestamp_ntz(F.col("DATE"), F.lit("yyyyMMddHH"))
    return ri.select(
        basin_long_name("BASIN").alias("BASIN"),
        clean.storm_id(F.col("BASIN"), F.col("CYCLONE NO"), F.year(ts)).alias("ATCFID"),
        ts.alias("DATE_full"), technique_name("Tech").alias("Tech"),
        F.col("ProbItem").try_cast("double").alias("ProbItem"),
        F.col("Intensity Change").try_cast("int").alias("Intensity Change"),
        F.col("RIstopTAU").try_cast("int").alias("RIstopTAU"))


@register("ingest_intensity_records", f"""
SELECT printf('%02d', storm_id) AS "CYCLONE NO", DATE_full, {R('prob')} AS ProbItem, CAST(n AS VARCHAR) AS HalfRange
FROM forecasts WHERE Tech = 'error'
""", ("forecasts",))
def q_ingest_intensity_records(spark, sf_dir):
    """S3: IN records (12-field layout) routed on the 4th field."""
    t = _ri(spark, sf_dir, "IN")
    return t.select("CYCLONE NO", F.to_timestamp_ntz(F.col("DATE"), F.lit("yyyyMMddHH")).alias("DATE_full"),
                    F.col("ProbItem").try_cast("double").alias("ProbItem"), "HalfRange")


@register("ingest_wind_records", f"""
SELECT printf('%02d', storm_id) AS "CYCLONE NO", DATE_full, {_NAME_SQL} AS Tech, {R('prob')} AS ProbItem, 30 AS "Intensity Change",
       CASE WHEN n > 1 THEN 48 ELSE 24 END AS RIstopTAU
FROM forecasts WHERE Tech IN ('purchase', 'signup')
""", ("forecasts",))
def q_ingest_wind_records(spark, sf_dir):
    """S3: RW records (the RI layout) routed on the 4th field."""
    t = _ri(spark, sf_dir, "RW")
    return t.select("CYCLONE NO", F.to_timestamp_ntz(F.col("DATE"), F.lit("yyyyMMddHH")).alias("DATE_full"), technique_name("Tech").alias("Tech"),
                    F.col("ProbItem").try_cast("double").alias("ProbItem"), F.col("Intensity Change").try_cast("int").alias("Intensity Change"),
                    F.col("RIstopTAU").try_cast("int").alias("RIstopTAU"))


@register("map_older_names", f"""
SELECT CASE Tech WHEN 'click' THEN 'Consensus' ELSE {_CODE_SQL} END AS Technique,
       CASE Tech WHEN 'view' THEN 'Logistic Reg.' ELSE Tech END AS Model, count(*) AS n
FROM forecasts WHERE Tech <> 'error' GROUP BY ALL
""", ("forecasts",))
def q_map_older_names(spark, sf_dir):
    """2019 technique names and model renames (an RI model is saved under its solver's name)."""
    t = decks.ingest_prob_forecasts_v2019(spark, render.write_deck_lines(spark, sf_dir)).where(F.col("Format") != "IN")
    solver = {v: k for k, v in render.TECH_CODES.items()}
    saved = F.create_map(*[F.lit(x) for code, name in solver.items() for x in (code, "lbfgs" if name == "view" else name)])
    return t.groupBy(technique_name("Technique", older=True).alias("Technique"), model_name(saved[F.col("Technique")]).alias("Model")).count() \
        .withColumnRenamed("count", "n")


@register("select_forecast_window", f"""
SELECT storm_id, DATE_full, {R('prob')} AS ProbItem FROM forecasts WHERE Tech = 'click' AND n <= 1
""", ("forecasts",))
def q_select_forecast_window(spark, sf_dir):
    """Window 0-24 h, change 30 kt, technique list."""
    ri = _ri(spark, sf_dir).withColumns({c: F.col(c).try_cast("int") for c in
                                         ("RIstartTAU", "RIstopTAU", "Intensity Change")})
    w = clean.select_forecast_window(ri, techniques=["RIOC"])
    return w.select(F.col("CYCLONE NO").try_cast("bigint").alias("storm_id"),
                    F.to_timestamp_ntz(F.col("DATE"), F.lit("yyyyMMddHH")).alias("DATE_full"),
                    F.col("ProbItem").try_cast("double").alias("ProbItem"))


@register("high_probability_cases", f"""
SELECT storm_id, DATE_full, {R('prob')} AS ProbItem FROM forecasts WHERE Tech = 'view' AND prob > 70
""", ("forecasts",))
def q_high_probability_cases(spark, sf_dir):
    """Probability above 70 % for the 40-kt change."""
    ri = _ri(spark, sf_dir).withColumns({"p": F.col("ProbItem").try_cast("double"),
                                         "chg": F.col("Intensity Change").try_cast("int")})
    h = clean.high_probability_cases(ri, "p", "chg", min_prob=70, change=40)
    return h.select(F.col("CYCLONE NO").try_cast("bigint").alias("storm_id"),
                    F.to_timestamp_ntz(F.col("DATE"), F.lit("yyyyMMddHH")).alias("DATE_full"),
                    F.col("p").alias("ProbItem"))


@register("drop_outlier_probability", f"""
SELECT storm_id, DATE_full, {_CODE_SQL} AS Tech, {R('prob')} AS ProbItem FROM forecasts WHERE Tech IN ('click', 'view') AND prob <= 90
""", ("forecasts",))
def q_drop_outlier_probability(spark, sf_dir):
    """Rows above the outlier limit dropped (limit 90 on this data; 500 in the reference)."""
    ri = _ri(spark, sf_dir).withColumn("ProbItem", F.col("ProbItem").try_cast("double"))
    d = clean.drop_outlier_probability(ri, "ProbItem", 90)
    return d.select(F.col("CYCLONE NO").try_cast("bigint").alias("storm_id"),
                    F.to_timestamp_ntz(F.col("DATE"), F.lit("yyyyMMddHH")).alias("DATE_full"), "Tech", "ProbItem")


@register("filter_named_storms", f"""
SELECT storm_id, DATE_full, {_CODE_SQL} AS Tech FROM forecasts
WHERE Tech IN ('click', 'view') AND storm_id BETWEEN 1 AND 50 AND {_BASIN_SQL} <> 'IO'
""", ("forecasts",))
def q_filter_named_storms(spark, sf_dir):
    """P8 + P9: cyclone numbers 1-50 only, basin IO excluded."""
    ri = _ri(spark, sf_dir)
    x = clean.filter_named_storms(ri, F.col("CYCLONE NO").try_cast("int"))
    x = clean.exclude_basin(x, "IO")
    return x.select(F.col("CYCLONE NO").try_cast("bigint").alias("storm_id"),
                    F.to_timestamp_ntz(F.col("DATE"), F.lit("yyyyMMddHH")).alias("DATE_full"), "Tech")


@register("strip_commas", f"""
SELECT replace(concat_ws(', ', {_BASIN_SQL}, printf('%02d', storm_id), strftime(DATE_full, '%Y%m%d%H')), ',', '') AS k
FROM forecasts
""", ("forecasts",))
def q_strip_commas(spark, sf_dir):
    """Commas removed from a string column."""
    lines = spark.read.text(render.write_deck_lines(spark, sf_dir))
    k = F.concat_ws(", ", *[F.get(F.split("value", ", "), i) for i in range(3)])
    return clean.strip_commas(lines.select(k.alias("k")), ["k"])


@register("ingest_prob_forecasts_v2019", f"""
SELECT {_BASIN_SQL} || printf('%02d', storm_id) || CAST(year(DATE_full) AS VARCHAR) AS ATCFID,
       {_CODE_SQL} AS Technique, {R('prob')} AS Probability
FROM forecasts WHERE Tech <> 'error'
""", ("forecasts",))
def q_ingest_prob_forecasts_v2019(spark, sf_dir):
    """Older 14-column layout with ATCF id (IN lines have 12 fields)."""
    t = decks.ingest_prob_forecasts_v2019(spark, render.write_deck_lines(spark, sf_dir))
    t = t.where(F.col("Format") != "IN")
    return t.select("ATCFID", "Technique", F.col("Probability").try_cast("double").alias("Probability"))


@register("ingest_prob_forecasts_multi_year", f"""
SELECT CAST(year(DATE_full) AS INTEGER) AS YEAR,
       {_BASIN_SQL} || printf('%02d', storm_id) || CAST(year(DATE_full) AS VARCHAR) AS ATCFID,
       {_CODE_SQL} AS Tech, {R('prob')} AS ProbItem
FROM forecasts WHERE Tech <> 'error'
""", ("forecasts",))
def q_ingest_prob_forecasts_multi_year(spark, sf_dir):
    """Year folders by glob, RI + RW records, YEAR and ATCF id."""
    root = render.write_deck_lines(spark, sf_dir, by_year=True)
    t = decks.ingest_prob_forecasts_multi_year(spark, [f"{root}/year=*"], max_path_len=4096)
    return t.select("YEAR", "ATCFID", "Tech", F.col("ProbItem").try_cast("double").alias("ProbItem"))


@register("drop_long_paths", f"""
SELECT CAST(year(DATE_full) AS INTEGER) AS YEAR, count(*) AS n FROM forecasts WHERE Tech <> 'error' AND year(DATE_full) % 2 = 0 GROUP BY ALL
""", ("forecasts",))
def q_drop_long_paths(spark, sf_dir):
    """Files whose path is longer than the limit take no part (here: those of odd years)."""
    root = render.write_deck_lines(spark, sf_dir, by_year=True, long_name=lambda year: year % 2 == 1)
    sizes = spark.read.text(f"{root}/*/year=*").select(F.length(F.col("_metadata.file_path")).alias("n")).agg(F.min("n")).first()  # one row
    t = decks.ingest_prob_forecasts_multi_year(spark, [f"{root}/*/year=*"], max_path_len=(sizes[0] or 0) + render.LONG_NAME // 2)
    return t.groupBy("YEAR").count().withColumnRenamed("count", "n")


@register("ingest_best_track", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY DATE_full) AS pos FROM cycles)
SELECT 'AL' || printf('%02d', a.storm_id) || CAST(year(a.DATE_full) AS VARCHAR) AS ATCFID,
       a.DATE_full, {R('a.VMAX')} AS VMAX,
       CASE WHEN b.DATE_full = a.DATE_full + INTERVAL 1 DAY THEN {R('b.VMAX - a.VMAX')} END AS d24_VMAX
FROM p a LEFT JOIN p b ON a.storm_id = b.storm_id AND b.pos = a.pos + 4
""", ("cycles",))
def q_ingest_best_track(spark, sf_dir):
    """S6 + P18 + W3: short track lines null-padded, 34-kt rows, 24-h change."""
    t = decks.ingest_best_track(spark, render.write_track_lines(spark, sf_dir))
    t = clean.filter_wind_radius(t.withColumn("RAD", F.col("RAD").try_cast("int")))
    t = t.select("ATCFID", "DATE_full", F.col("VMAX").try_cast("double").alias("VMAX"))
    return series.track_change(t, ["ATCFID"], "DATE_full", ("VMAX",))


@register("load_scale_factors", """
SELECT p_name AS name, CAST(p_size AS DOUBLE) AS factor, p_brand AS unit, p_type AS descr FROM part
""")
def q_load_scale_factors(spark, sf_dir):
    """JSON factor dictionaries -> (name, factor, unit, descr)."""
    return diagnostics.load_scale_factors(spark, render.write_factor_json(spark, sf_dir), json_lines=True)


@register("load_scale_factors_by_file", """
SELECT p_name || ' ' || p_partkey AS name, CAST(p_size AS DOUBLE) AS factor, p_brand AS unit, p_type AS descr FROM part
""")
def q_load_scale_factors_by_file(spark, sf_dir):
    """One JSON object per file, over many lines, with many names."""
    return diagnostics.load_scale_factors(spark, render.write_factor_files(spark, sf_dir))


@register("factor_lookup", f"""
SELECT case_id, TIME, {R('VMAX / 10.0')} AS VMAX, {R('SHRG')} AS SHRG
FROM (SELECT case_id, TIME, VMAX, nullif(SHRG, 9999) AS SHRG FROM hours)
""", ("hours",))
def q_factor_lookup(spark, sf_dir):
    """P3 + J8: long (case, hour, predictor) rows scaled by a broadcast factor
    table (VMAX / 10; SHRG has no factor), back to wide."""
    h = clean.sentinel_to_null(V.hours(spark, sf_dir).select("case_id", "TIME", "VMAX", "SHRG"), ["SHRG"])
    long = h.select("case_id", "TIME", F.explode(F.array(
        F.struct(F.lit("VMAX").alias("name"), F.col("VMAX").cast("string").alias("value")),
        F.struct(F.lit("SHRG").alias("name"), F.col("SHRG").cast("string").alias("value")))).alias("p")
    ).select("case_id", "TIME", "p.*")
    factors = spark.createDataFrame([("VMAX", 10.0)], "name string, factor double")
    scaled = clean.apply_scale_factors_long(long, factors)
    # one aggregate; a pivot groups by (case, hour, name) first, in tables twice as long
    return scaled.groupBy("case_id", "TIME").agg(*[F.first(F.when(F.col("name") == p, F.col("value")), ignorenulls=True).alias(p) for p in ("VMAX", "SHRG")])


@register("apply_scale_factors", f"""
SELECT case_id, TIME, {R('VMAX / 10.0')} AS VMAX, {R('DTL / 100.0')} AS DTL FROM hours
""", ("hours",))
def q_apply_scale_factors(spark, sf_dir):
    """P3 (wide): divide by each column's factor, coerce to double."""
    h = V.hours(spark, sf_dir).select("case_id", "TIME", F.col("VMAX").cast("string").alias("VMAX"),
                                      F.col("DTL").cast("string").alias("DTL"))
    return clean.apply_scale_factors(h, {"VMAX": 10.0, "DTL": 100.0})


@register("load_processed", f"""
SELECT BASIN, YEAR, case_id, TIME, {R('VMAX')} AS VMAX FROM cases WHERE BASIN = 'ASIA' AND YEAR BETWEEN 1996 AND 1998
""", ("cases",))
def q_load_processed(spark, sf_dir):
    """Features written partitioned by (BASIN, YEAR), read back with
    partition pruning."""
    path = results.shared_path(spark, "processed")
    c = V.cases(spark, sf_dir).select("BASIN", "YEAR", "case_id", "TIME", "VMAX")
    results.write_results(c, path, ["BASIN", "YEAR"])
    return results.load_processed(spark, path, basin="ASIA", years=(1996, 1998)).select(
        "BASIN", "YEAR", "case_id", "TIME", "VMAX")


@register("load_products", f"""
WITH b AS (SELECT Model, BASIN, CASE WHEN round_even(p1 * 10, 0) * 10 <= 5 THEN 5.0 ELSE round_even(p1 * 10, 0) * 10 END AS pct, y_true FROM scored)
SELECT Model, BASIN AS Predicted_Basin, {R('pct')} AS Predicted_Pct, count(*) AS Observed_No_Total,
       {R('100.0 * count(*) FILTER (WHERE y_true = 1) / count(*)')} AS Observed_Pct
FROM b WHERE pct <> 100 GROUP BY ALL
""", ("scored",))
def q_load_products(spark, sf_dir):
    """Reliability table written as CSV, read back with a fixed schema."""
    from gale.operators.reliability import reliability_from_predictions
    rel = reliability_from_predictions(V.scored(spark, sf_dir), "Model", "BASIN", "p1", "y_true")
    path = results.shared_path(spark, "products-csv")
    rel.write.option("header", "true").csv(path)
    back = results.load_csv(spark, path, "Model string, Predicted_Basin string, Predicted_Pct double, "
                            "Observed_No_RI long, Observed_No_Total long, Observed_Pct double",
                            drop=("Observed_No_RI",))
    return back


@register("reload_contingency", """
SELECT Model, BASIN, CAST(sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS n
FROM scored GROUP BY ALL
""", ("scored",))
def q_reload_contingency(spark, sf_dir):
    """S11 + S13: per-fold counts written partitioned by (Model, BASIN) and re-read."""
    s = V.scored(spark, sf_dir)
    c = s.groupBy("Model", "BASIN", "Fold").agg(
        F.sum((F.col("y_true") == F.col("y_pred")).cast("long")).alias("correct"), F.count(F.lit(1)).alias("n"))
    path = results.shared_path(spark, "contingency")
    results.write_results(c, path, ["Model", "BASIN"])
    back = results.reload_results(spark, path)
    return back.groupBy("Model", "BASIN").agg(F.sum("correct").cast("bigint").alias("correct"),
                                             F.sum("n").cast("bigint").alias("n"))
