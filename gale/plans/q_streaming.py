"""Streaming queries (R1, R3); each has the same result as its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from gale.plans import render
from gale.plans import views as V
from gale.plans.catalog import ORACLE, R, register
from gale.plans.q_features import f3
from gale.plans.q_ingest import _S1_OUT_SQL, _s1_out
from gale.sources.tables import read_table
from gale.streaming import jobs


@register("stream_ingest_cases", _S1_OUT_SQL, ("cases",))
def q_stream_ingest_cases(spark, sf_dir):
    """Case-record files ingested by a file stream (availableNow)."""
    path = render.write_case_records(spark, sf_dir)
    df = jobs.stream_ingest_cases(spark, path, ["VMAX", "ASTX", "SHRG", "RSST", "IR00", "PC00"],
                                  with_age=["RSST", "PC00"])
    return _s1_out(df)


@register("stream_case_features", ORACLE["case_features"])
def q_stream_case_features(spark, sf_dir):
    """R1 to features: record files arrive in several micro-batches, each goes through
    the whole case chain (F3) before it reaches the sink."""
    def chain(rows):
        x = rows.withColumns({p: F.col(p).try_cast("double") for p in V.PREDICTORS}).where(F.col("VMAX") != V.SENTINEL)
        x = x.withColumns({"BASIN": F.translate(F.split_part("ATCFID", F.lit("-"), F.lit(1)), "~", " "),
                           "case_id": F.split_part("ATCFID", F.lit("-"), F.lit(2)).cast("bigint"), "NAME": F.translate("NAME", "~", " ")})
        return f3(x.drop("ATCFID"))
    return jobs.stream_ingest_cases(spark, render.write_feature_records(spark, sf_dir), V.PREDICTORS, transform=chain, files_per_batch=16)


@register("stream_cycle_counts", f"""
SELECT date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 6 AS BIGINT)) AS window_start, event_type,
       count(*) AS n, {R('avg(value)')} AS mean_value
FROM events GROUP BY ALL
""")
def q_stream_cycle_counts(spark, sf_dir):
    """6-hour tumbling counts and means per event type with a watermark, files arriving in several micro-batches."""
    ev = read_table(spark, sf_dir, "events")
    return jobs.stream_cycle_counts(spark, render.write_arrivals(ev, "ts", "events-arrive", 8), ev.schema, watermark="30 hours", files_per_batch=2)


@register("stream_verify_24h", f"""
SELECT a.storm_id, a.DATE_full, {R('b.VMAX - a.VMAX')} AS d_V
FROM cycles a JOIN cycles b ON a.storm_id = b.storm_id AND b.DATE_full = a.DATE_full + INTERVAL 1 DAY
""", ("cycles",))
def q_stream_verify_24h(spark, sf_dir):
    """R2: +24 h verification as a stream-stream join with watermarks, cycle files
    arriving in order of time in several micro-batches."""
    cyc = V.cycles(spark, sf_dir).select("storm_id", "DATE_full", "VMAX")
    schema = "storm_id bigint, DATE_full timestamp_ntz, VMAX double"
    return jobs.stream_verify_24h(spark, render.write_arrivals(cyc, "DATE_full", "cycles-arrive", 8), schema, watermark="30 hours", files_per_batch=2)
