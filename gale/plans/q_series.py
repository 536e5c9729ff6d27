"""Queries over per-storm series and per-case hours."""

from __future__ import annotations


from gale.functions.labels import class_label, intensity_class
from gale.operators import explore, series
from gale.plans import views as V
from gale.plans.catalog import R, register

# ----------------------------------------------------------------- W1


@register("change_24h", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY DATE_full) AS pos FROM cycles)
SELECT a.storm_id, a.DATE_full, a.grp, {R('b.VMAX - a.VMAX')} AS d24_VMAX, {R('b.MSLP - a.MSLP')} AS d24_MSLP
FROM p a JOIN p b ON a.storm_id = b.storm_id AND b.pos = a.pos + 4
WHERE b.DATE_full = a.DATE_full + INTERVAL 1 DAY
""", ("cycles",))
def q_change_24h(spark, sf_dir):
    """24-hour change over four 6-hour cycles of one storm, 1-day guard."""
    cyc = V.cycles(spark, sf_dir, materialized=True)
    return series.change_24h(cyc, ["storm_id"], "DATE_full", ["VMAX", "MSLP"], carry=["grp"])


# ------------------------------------------------------------ P20 / P21

_W1_SQL = """
p AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY DATE_full) AS pos FROM cycles),
w1 AS (SELECT a.storm_id, a.DATE_full, a.grp, b.VMAX - a.VMAX AS d24_VMAX
       FROM p a JOIN p b ON a.storm_id = b.storm_id AND b.pos = a.pos + 4
       WHERE b.DATE_full = a.DATE_full + INTERVAL 1 DAY)
"""


def _w1(spark, sf_dir, materialized: bool = False):
    cyc = V.cycles(spark, sf_dir, materialized=True)
    w1 = series.change_24h(cyc, ["storm_id"], "DATE_full", ["VMAX"], carry=["grp"])
    if materialized:  # the change table feeds several branches downstream
        from gale.session import materialize
        return materialize(w1)
    return w1


@register("classify_intensity", f"""
WITH {_W1_SQL}
SELECT storm_id, DATE_full, {R('d24_VMAX')} AS d24_VMAX,
  CASE WHEN d24_VMAX >= 30 THEN 1 ELSE 0 END AS class_2,
  CASE WHEN d24_VMAX >= 30 THEN 2 WHEN d24_VMAX <= -30 THEN -2
       WHEN d24_VMAX >= 10 AND d24_VMAX < 30 THEN 1 WHEN d24_VMAX > -30 AND d24_VMAX <= -10 THEN -1
       ELSE 0 END AS class_5,
  CASE WHEN d24_VMAX >= 10 THEN 1 WHEN d24_VMAX <= -10 THEN -1 ELSE 0 END AS class_3,
  CASE WHEN d24_VMAX >= 30 THEN 'RI' ELSE 'no RI' END AS label_2,
  CASE WHEN d24_VMAX >= 30 THEN 'RI' WHEN d24_VMAX <= -30 THEN 'RW'
       WHEN d24_VMAX >= 10 AND d24_VMAX < 30 THEN 'I' WHEN d24_VMAX > -30 AND d24_VMAX <= -10 THEN 'W'
       ELSE 'SS' END AS label_5
FROM w1
""", ("cycles",))
def q_classify_intensity(spark, sf_dir):
    """2-, 3- and 5-class intensity classes and labels of W1 changes."""
    d = _w1(spark, sf_dir)
    return d.select(
        "storm_id", "DATE_full", "d24_VMAX",
        intensity_class("d24_VMAX", 2).alias("class_2"),
        intensity_class("d24_VMAX", 5).alias("class_5"),
        intensity_class("d24_VMAX", 3).alias("class_3"),
        class_label(intensity_class("d24_VMAX", 2), 2).alias("label_2"),
        class_label(intensity_class("d24_VMAX", 5), 5).alias("label_5"))


# ----------------------------------------------------------------- A4


@register("event_rate_by_basin", f"""
WITH {_W1_SQL}
SELECT grp, {R('100.0 * count(*) FILTER (WHERE d24_VMAX >= 30) / nullif(count(d24_VMAX), 0)')} AS event_pct,
       count(d24_VMAX) AS n_changes, count(*) FILTER (WHERE d24_VMAX >= 30) AS n_events
FROM w1 GROUP BY grp
""", ("cycles",))
def q_event_rate_by_basin(spark, sf_dir):
    """A4 (flagship): W1 change -> P20 class edge -> % of changes >= 30 per group."""
    return explore.event_rate(_w1(spark, sf_dir), ["grp"], "d24_VMAX", 30.0)


# ------------------------------------------------------------ W2, W3, W4


@register("change_24h_realtime", f"""
WITH p AS (SELECT *, row_number() OVER (ORDER BY DATE_full, storm_id) AS pos FROM cycles)
SELECT a.storm_id, a.DATE_full,
       CASE WHEN b.DATE_full = a.DATE_full + INTERVAL 1 DAY THEN {R('b.VMAX - a.VMAX')} END AS d24_VMAX
FROM p a LEFT JOIN p b ON b.pos = a.pos + 4
""", ("cycles",))
def q_change_24h_realtime(spark, sf_dir):
    """Realtime 24-h change: all storms in date order as one series."""
    cyc = V.cycles(spark, sf_dir, materialized=True)
    return series.change_24h_realtime(cyc, "DATE_full", ["VMAX"], tiebreak=["storm_id"]).select(
        "storm_id", "DATE_full", "d24_VMAX")


@register("track_change", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY DATE_full) AS pos FROM cycles)
SELECT a.storm_id, a.DATE_full, {R('a.VMAX')} AS VMAX, {R('a.MSLP')} AS MSLP, a.grp, a.n,
       CASE WHEN b.DATE_full = a.DATE_full + INTERVAL 1 DAY THEN {R('b.VMAX - a.VMAX')} END AS d24_VMAX,
       CASE WHEN b.DATE_full = a.DATE_full + INTERVAL 1 DAY THEN {R('b.MSLP - a.MSLP')} END AS d24_MSLP
FROM p a LEFT JOIN p b ON a.storm_id = b.storm_id AND b.pos = a.pos + 4
""", ("cycles",))
def q_track_change(spark, sf_dir):
    """d24 VMAX and MSLP written onto every track row."""
    return series.track_change(V.cycles(spark, sf_dir, materialized=True), ["storm_id"], "DATE_full")


@register("change_reverse", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY DATE_full) AS pos FROM cycles)
SELECT a.storm_id, a.DATE_full, {R('b.VMAX - a.VMAX')} AS d_rev
FROM p a JOIN p b ON a.storm_id = b.storm_id AND b.pos = a.pos - 4
WHERE b.VMAX - a.VMAX >= 40
""", ("cycles",))
def q_change_reverse(spark, sf_dir):
    """Earlier-minus-current change over 4 rows, kept when >= 40."""
    return series.change_reverse(V.cycles(spark, sf_dir, materialized=True), ["storm_id"], "DATE_full", "VMAX")


# ------------------------------------------------------------------ J4


@register("exact_time_change", f"""
SELECT a.storm_id, a.DATE_full, {R('a.VMAX')} AS VMAX, {R('a.MSLP')} AS MSLP, a.grp, a.n,
       {R('b.VMAX - a.VMAX')} AS d_V
FROM cycles a LEFT JOIN cycles b ON a.storm_id = b.storm_id AND b.DATE_full = a.DATE_full + INTERVAL 1 DAY
""", ("cycles",))
def q_exact_time_change(spark, sf_dir):
    """Change to exactly +24 h by self equi-join on (storm, time)."""
    return series.exact_time_change(V.cycles(spark, sf_dir, materialized=True), ["storm_id"], "DATE_full")


@register("event_rate_exact", f"""
WITH j AS (SELECT a.grp, b.VMAX - a.VMAX AS d_V
           FROM cycles a LEFT JOIN cycles b ON a.storm_id = b.storm_id AND b.DATE_full = a.DATE_full + INTERVAL 1 DAY)
SELECT grp, {R('100.0 * count(*) FILTER (WHERE d_V >= 30) / nullif(count(d_V), 0)')} AS event_pct,
       count(d_V) AS n_changes, count(*) FILTER (WHERE d_V >= 30) AS n_events
FROM j GROUP BY grp
""", ("cycles",))
def q_event_rate_exact(spark, sf_dir):
    """A4 over J4 changes (the realtime verification rate)."""
    d = series.exact_time_change(V.cycles(spark, sf_dir, materialized=True), ["storm_id"], "DATE_full")
    return explore.event_rate(d, ["grp"], "d_V", 30.0)


# ----------------------------------------------------------------- W10


@register("number_cases", """
SELECT storm_id, DATE_full, row_number() OVER (PARTITION BY storm_id ORDER BY DATE_full) AS CASE_NO
FROM cycles
""", ("cycles",))
def q_number_cases(spark, sf_dir):
    """Running case number per storm (distributed positions)."""
    cyc = V.cycles(spark, sf_dir, materialized=True).select("storm_id", "DATE_full")
    return series.number_cases(cyc, ["storm_id"], ["DATE_full"], "CASE_NO")
