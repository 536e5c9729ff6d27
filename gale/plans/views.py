"""Stand-in inputs built from the driver tables.

The storm tables the library works on (case diagnostics, forecasts, tracks,
predictions) are not in the driver data, so each view below only renames
driver columns into the schema an operator expects. No view does any of an
operator's work; the operators run unchanged on real storm tables.

Every view has a Spark builder and an identical DuckDB definition
(``*_SQL``) used by the oracle queries.

cycles  events per (user, 6-hour slot): a series per storm with natural gaps
hours   lineitem per (order, line): a case with forecast hours -12..24 and a
        deterministic rule that writes the 9999 missing-value sentinel
cases   hours joined to orders/customer/nation/region: basin, storm, date
scored  lineitem rows as predictions: truth, probability, model, fold, basin
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gale.functions.hashing import md5_number
from gale.sources.tables import read_table

SENTINEL = 9999.0

# ----------------------------------------------------------------- cycles


def cycles(spark: SparkSession, sf_dir: str, materialized: bool = False) -> DataFrame:
    """With ``materialized`` the series table is checkpointed once (it feeds
    several branches of the series plans)."""
    if materialized:
        from gale.session import materialize
        return materialize(cycles(spark, sf_dir))
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "value", "event_type")
    slot = (F.date_trunc("hour", "ts") - F.make_dt_interval(F.lit(0), F.hour("ts") % 6))\
        .cast("timestamp_ntz")
    return (ev.groupBy(F.col("user_id").alias("storm_id"), slot.alias("DATE_full"))
            .agg(F.avg("value").alias("VMAX"), F.min("value").alias("MSLP"),
                 F.max("event_type").alias("grp"), F.count(F.lit(1)).alias("n")))


CYCLES_SQL = """
SELECT user_id AS storm_id,
       date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 6 AS BIGINT)) AS DATE_full,
       avg(value) AS VMAX, min(value) AS MSLP, max(event_type) AS grp, count(*) AS n
FROM events GROUP BY 1, 2
"""

# -------------------------------------------------------------- forecasts


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability forecasts: one per (user, 6-hour slot, event type) with
    the largest event value as the probability in percent."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "value", "event_type")
    slot = (F.date_trunc("hour", "ts") - F.make_dt_interval(F.lit(0), F.hour("ts") % 6))\
        .cast("timestamp_ntz")
    return (ev.groupBy(F.col("user_id").alias("storm_id"), slot.alias("DATE_full"),
                       F.col("event_type").alias("Tech"))
            .agg(F.max("value").alias("prob"), F.count(F.lit(1)).alias("n")))


FORECASTS_SQL = """
SELECT user_id AS storm_id,
       date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 6 AS BIGINT)) AS DATE_full,
       event_type AS Tech, max(value) AS prob, count(*) AS n
FROM events GROUP BY 1, 2, 3
"""

# ------------------------------------------------------------------ hours

PREDICTORS = ["VMAX", "VMPI", "DELV", "SHRG", "D200", "Z850", "RHMD", "DTL",
              "NSST", "RSST", "IR00", "IRM1", "IRM3", "PC00", "PCM1", "PCM3"]


def hours(spark: SparkSession, sf_dir: str, materialized: bool = False) -> DataFrame:
    if materialized:
        from gale.session import materialize
        return materialize(hours(spark, sf_dir))
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax")
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")

    def sentinel(cond, value):
        return F.when(cond, F.lit(SENTINEL)).otherwise(value)

    # Values are built from exact integer arithmetic (few decimals) so that
    # every engine computes identical doubles.
    g = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("VMAX"),
        (F.floor(F.max("l_extendedprice") / 500.0)).cast("double").alias("VMPI"),
        F.round(F.sum("l_tax") * 100.0).alias("DELV"),
        F.round(F.sum("l_discount") * 100.0).alias("_shrg"),
        F.round(F.sum("l_tax") * 1000.0).alias("D200"),
        F.round((F.sum("l_discount") - F.sum("l_tax")) * 100.0).alias("Z850"),
        (F.avg("l_quantity") * 2.0).alias("RHMD"),
        (F.min("l_suppkey") * 10).cast("double").alias("DTL"),
        F.round(F.sum("l_discount") * 1000.0).alias("NSST"),
        (F.round(F.sum("l_tax") * 1000.0) + 200.0).alias("RSST"),
        (F.floor(F.max("l_extendedprice")) / 100.0).alias("_ir00"),
        (F.floor(F.min("l_extendedprice")) / 100.0).alias("_irm1"),
        (F.floor(F.max("l_extendedprice") / 10.0) / 100.0).alias("IRM3"),
        (F.round(F.sum("l_discount") * 100.0) / 10.0).alias("_pc00"),
        (F.round(F.max("l_discount") * 100.0) / 10.0).alias("_pcm1"),
        (F.round(F.min("l_discount") * 100.0) / 10.0).alias("PCM3"),
    )
    return g.select(
        F.col("l_orderkey").alias("case_id"),
        ((ln - 3) * 6).cast("int").alias("TIME"),
        "VMAX", "VMPI", "DELV",
        sentinel(((ok % 11 == 0) & (ln > 2)) | ((ok + ln) % 5 == 0), F.col("_shrg")).alias("SHRG"),
        "D200", "Z850", "RHMD", "DTL", "NSST", "RSST",
        sentinel(ok % 3 == 0, F.col("_ir00")).alias("IR00"),
        sentinel(ok % 4 == 1, F.col("_irm1")).alias("IRM1"),
        "IRM3",
        sentinel((ok + ln) % 4 == 0, F.col("_pc00")).alias("PC00"),
        sentinel(ok % 6 == 5, F.col("_pcm1")).alias("PCM1"),
        "PCM3",
    )


HOURS_SQL = """
SELECT l_orderkey AS case_id, CAST((l_linenumber - 3) * 6 AS INTEGER) AS TIME,
       sum(l_quantity) AS VMAX, CAST(floor(max(l_extendedprice) / 500.0) AS DOUBLE) AS VMPI,
       round(sum(l_tax) * 100.0) AS DELV,
       CASE WHEN (l_orderkey % 11 = 0 AND l_linenumber > 2) OR (l_orderkey + l_linenumber) % 5 = 0
            THEN 9999.0 ELSE round(sum(l_discount) * 100.0) END AS SHRG,
       round(sum(l_tax) * 1000.0) AS D200, round((sum(l_discount) - sum(l_tax)) * 100.0) AS Z850,
       avg(l_quantity) * 2.0 AS RHMD, CAST(min(l_suppkey) * 10 AS DOUBLE) AS DTL,
       round(sum(l_discount) * 1000.0) AS NSST, round(sum(l_tax) * 1000.0) + 200.0 AS RSST,
       CASE WHEN l_orderkey % 3 = 0 THEN 9999.0 ELSE floor(max(l_extendedprice)) / 100.0 END AS IR00,
       CASE WHEN l_orderkey % 4 = 1 THEN 9999.0 ELSE floor(min(l_extendedprice)) / 100.0 END AS IRM1,
       floor(max(l_extendedprice) / 10.0) / 100.0 AS IRM3,
       CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN 9999.0 ELSE round(sum(l_discount) * 100.0) / 10.0 END AS PC00,
       CASE WHEN l_orderkey % 6 = 5 THEN 9999.0 ELSE round(max(l_discount) * 100.0) / 10.0 END AS PCM1,
       round(min(l_discount) * 100.0) / 10.0 AS PCM3
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

# ------------------------------------------------------------------ cases


def case_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case: basin, storm, name, issue time, year."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(n, F.col("c_nationkey") == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey)
            .select(F.col("r_name").alias("BASIN"),
                    F.col("n_nationkey").cast("bigint").alias("storm_id"),
                    F.col("n_name").alias("NAME"),
                    F.col("o_orderkey").alias("case_id"),
                    F.col("o_orderdate").alias("DATE_full"),
                    F.year("o_orderdate").cast("int").alias("YEAR")))


def cases(spark: SparkSession, sf_dir: str, materialized: bool = False) -> DataFrame:
    c = case_keys(spark, sf_dir).join(hours(spark, sf_dir), "case_id")
    if materialized:
        from gale.session import materialize
        return materialize(c)
    return c


CASE_KEYS_SQL = """
SELECT r_name AS BASIN, CAST(n_nationkey AS BIGINT) AS storm_id, n_name AS NAME,
       o_orderkey AS case_id, o_orderdate AS DATE_full, CAST(year(o_orderdate) AS INTEGER) AS YEAR
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

CASES_SQL = """
SELECT k.*, h.* EXCLUDE (case_id) FROM case_keys k JOIN hours h ON k.case_id = h.case_id
"""

# ----------------------------------------------------------------- scored


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        "l_linestatus", "l_shipdate")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    u = md5_number("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey") % 1000
    p1 = (u + y * 300) / F.lit(1300.0)
    base = (li.join(s, li.l_suppkey == s.s_suppkey)
            .join(n, F.col("s_nationkey") == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey))
    return base.select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("case_key"),
        F.col("l_suppkey").alias("storm_id"),
        F.col("l_shipdate").alias("DATE_full"),
        F.col("r_name").alias("BASIN"),
        F.col("l_linestatus").alias("Model"),
        F.col("l_linenumber").cast("bigint").alias("Fold"),
        y.alias("y_true"),
        p1.alias("p1"),
        F.when(p1 >= 0.5, 1).otherwise(0).alias("y_pred"),
    )


SCORED_SQL = """
SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS case_key,
       l_suppkey AS storm_id, l_shipdate AS DATE_full, r_name AS BASIN,
       l_linestatus AS Model, CAST(l_linenumber AS BIGINT) AS Fold,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
       CAST(CAST(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15)) AS UBIGINT) % 1000
        + CASE WHEN l_returnflag = 'R' THEN 300 ELSE 0 END AS DOUBLE) / 1300.0 AS p1,
       CASE WHEN CAST(CAST(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15)) AS UBIGINT) % 1000
        + CASE WHEN l_returnflag = 'R' THEN 300 ELSE 0 END AS DOUBLE) / 1300.0 >= 0.5 THEN 1 ELSE 0 END AS y_pred
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

VIEW_SQL = {
    "cycles": CYCLES_SQL,
    "forecasts": FORECASTS_SQL,
    "hours": HOURS_SQL,
    "case_keys": CASE_KEYS_SQL,
    "cases": CASES_SQL,
    "scored": SCORED_SQL,
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs for ``names`` (dependencies first)."""
    order = ["cycles", "forecasts", "hours", "case_keys", "cases", "scored"]
    need = set(names)
    if "cases" in need:
        need |= {"hours", "case_keys"}
    ctes = [f"{v} AS ({VIEW_SQL[v].strip()})" for v in order if v in need]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        return "WITH " + ",\n".join(ctes) + ",\n" + body
    return "WITH " + ",\n".join(ctes) + "\n" + body
