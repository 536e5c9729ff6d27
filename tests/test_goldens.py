"""Hand-computed goldens and invariants for the sharp edges."""

import itertools

from pyspark.sql import functions as F

from gale.functions.labels import intensity_class
from gale.operators import clean, series, verify


def test_bin_probability_half_even(spark):
    df = spark.createDataFrame([(0.15,), (0.25,), (0.05,), (0.051,), (0.0,), (0.995,)], "p double")
    got = [r.b for r in df.select(clean.bin_probability("p").alias("b")).collect()]
    assert got == [20.0, 20.0, 5.0, 10.0, 5.0, 100.0]


def test_intensity_classes(spark):
    df = spark.createDataFrame([(30.0,), (29.9,), (-30.0,), (-10.0,), (10.0,), (None,)], "d double")
    five = [r.c for r in df.select(intensity_class("d", 5).alias("c")).collect()]
    two = [r.c for r in df.select(intensity_class("d", 2).alias("c")).collect()]
    assert five == [2, 1, -2, -1, 1, 0]
    assert two == [1, 0, 0, 0, 0, 0]


def test_interpolate_case(spark):
    rows = [(1, t, v) for t, v in [(0, None), (6, 2.0), (12, None), (18, None), (24, 8.0), (30, 9.0)]]
    rows += [(2, t, v) for t, v in [(0, None), (6, None), (12, 1.0), (18, None)]]  # 3/4 null: skipped
    rows += [(3, t, v) for t, v in [(0, 1.0), (6, None), (12, 3.0), (18, None)]]  # trailing: last value
    df = spark.createDataFrame(rows, "c int, TIME int, SHRG double")
    out = {(r.c, r.TIME): r.SHRG for r in series.interpolate_case(df, ["c"], "TIME", ["SHRG"]).collect()}
    assert out[(1, 0)] is None and out[(1, 12)] == 4.0 and out[(1, 18)] == 6.0
    assert out[(2, 18)] is None and out[(2, 0)] is None
    assert out[(3, 6)] == 2.0 and out[(3, 18)] == 3.0


def _pred(spark):
    rows = [(i % 2, (i * 37 % 101) / 101.0) for i in range(200)]
    rows = [(y, round(min(1.0, s + 0.3 * y), 2)) for y, s in rows]
    return spark.createDataFrame([("m", y, s, int(s >= 0.5)) for y, s in rows],
                                 "Model string, y int, p double, yhat int"), rows


def test_auc_is_pairwise_win_rate(spark):
    df, rows = _pred(spark)
    counts = verify.score_counts(df, ["Model"], "y", "p")
    auc = verify.roc_curve(counts, ["Model"]).select("AUC").first()[0]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    assert abs(auc - wins / (len(pos) * len(neg))) < 1e-12


def test_contingency_cells_sum(spark):
    df, rows = _pred(spark)
    cm = verify.contingency_stats(df, ["Model"], "y", "yhat", [0, 1]).collect()
    for r in cm:
        assert r.Hits + r.Misses == r.N_actual
        assert r.Hits + r.False_Alarms + r.Misses + r.Correct_Negs == len(rows)


def test_brier_closed_form(spark):
    df, rows = _pred(spark)
    b = {r.Threshold: r.BS for r in verify.brier_table(df, ["Model"], "y", "p").collect()}
    for k in range(11):
        p = k / 10
        want = sum((y - p) ** 2 for y, _ in rows) / len(rows)
        assert abs(b[p] - want) < 1e-12


def test_reliability_totals(spark):
    from gale.operators.reliability import reliability_from_predictions
    df, rows = _pred(spark)
    rel = reliability_from_predictions(df, "Model", "Model", "p", "y")
    total = rel.agg(F.sum("Observed_No_Total")).first()[0]
    top = sum(1 for _, s in rows if round(s * 100 / 10) * 10 == 100)
    assert total == len(rows) - top


def test_name_maps(spark):
    from gale.functions.names import basin_long_name, technique_name
    df = spark.createDataFrame([("AL", "RIOC"), ("CP", "RIOD"), ("SH", "LDA0"), ("XX", "ZZZZ")], "b string, t string")
    got = df.select(basin_long_name("b").alias("b1"), basin_long_name("b", merge_central=True).alias("b2"),
                    technique_name("t").alias("t1")).collect()
    assert [r.b1 for r in got] == ["ATLANTIC", "CENTRAL_PACIFIC", "SOUTHERN_HEM", "XX"]
    assert [r.b2 for r in got] == ["ATLANTIC", "EAST_PACIFIC", "SOUTHERN_HEM", "XX"]
    assert [r.t1 for r in got] == ["OP-CON", "SHIPS-RII", "RIPA", "ZZZZ"]


def test_w1_counts_match_survey(spark):
    import __spark_entry__ as E
    rows = E.queries()["event_rate_by_basin"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_changes for r in rows) == 246 and sum(r.n_events for r in rows) == 54


def test_case_edges(spark):
    rows = [(1, -12, 50.0, 3.0, 80.0), (1, 0, 40.0, None, 120.0), (1, 6, 45.0, 5.0, None),
            (2, 6, 30.0, 1.0, 90.0), (2, 12, 35.0, 2.0, 95.0)]            # case 2 has no hour 0
    df = spark.createDataFrame(rows, "c int, TIME int, VMAX double, DELV double, DTL double")
    df = df.withColumn("VMPI", F.col("VMAX") + 100)
    pot = {(r.c, r.TIME): r.POT for r in series.potential_intensity(df, ["c"]).collect()}
    assert pot[(1, 6)] == 145.0 - 40.0 and pot[(2, 6)] is None
    masked = {(r.c, r.TIME): r.VMAX for r in clean.land_mask(df, ["c", "TIME"]).collect()}
    assert masked[(1, -12)] is None and masked[(1, 0)] == 40.0 and masked[(1, 6)] == 45.0  # null DTL kept
    gated = {r.c for r in clean.landfall_gate(df.withColumn("DTL", F.lit(50.0)), ["c"]).collect()}
    assert gated == {2}
    slots = {r.c: (r.a, r.b) for r in series.slot_features(df, ["c"], "TIME", "VMAX", [6, 18], ["a", "b"]).collect()}
    assert slots[1] == (45.0, None) and slots[2] == (30.0, None)
    fb = spark.createDataFrame([(None, 2.0, 3.0), (None, None, 3.0), (1.0, 2.0, 3.0)], "IR00 double, IRM1 double, IRM3 double")
    assert [r.IR00 for r in series.fill_fallback(fb, {"IR00": ["IRM1", "IRM3"]}).collect()] == [2.0, 3.0, 1.0]
