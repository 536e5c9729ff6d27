"""Distributed positions and running sums equal whole-group windows, also
when one group holds a third of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gale.operators.scan import running_totals, with_position


def _data(spark):
    # group 0 holds a third of all rows (hot key), group null another slice;
    # order values unique per group
    return spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 11 == 1, F.lit(None))
        .otherwise(F.col("id") % 17).alias("g"),
        ((F.col("id") * 7919) % 100003).cast("double").alias("x"),
        (F.col("id") % 5).alias("v"))


def test_positions_match_row_number(spark):
    df = _data(spark)
    w = Window.partitionBy("g").orderBy("x")
    want = {(r.g, r.x): r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    for width in (None, 997.0):
        got = {(r.g, r.x): r._pos for r in with_position(df, ["g"], ["x"], bucket_width=width).collect()}
        assert got == want


def test_running_sums_descending(spark):
    df = _data(spark)
    w = Window.partitionBy("g").orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.g, r.x): r.s for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    got = {(r.g, r.x): r.S for r in running_totals(df, ["g"], ["x"], {"S": F.col("v")},
                                                   descending=True).collect()}
    assert got == want


def test_segmented_scan_matches_windows(spark):
    from gale.operators.scan import segmented_scan
    df = _data(spark)
    for down in (False, True):
        order = F.col("x").desc() if down else F.col("x").asc()
        w = Window.partitionBy("g").orderBy(order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        g = Window.partitionBy("g")
        want = df.select("g", "x", F.sum("v").over(upto).alias("S"), F.row_number().over(w).alias("pos"), F.lead("v").over(w).alias("nv"),
                         F.sum("v").over(g).alias("T"), F.min("x").over(g).alias("min_x"))
        want = want.withColumn("A", F.sum(F.col("x") * F.col("S")).over(g))
        for width in (5.0, 997.0, 1e9):
            got = segmented_scan(df, ["g"], ["x"], {"S": F.col("v")}, following={"nv": "v"}, totals={"T": F.sum("v"), "min_x": F.min("x")},
                                 products={"A": (F.col("x"), "S")}, descending=down, bucket_width=width)
            cols = ["g", "x", "S", "pos", "nv", "T", "min_x", "A"]
            rows = lambda d: sorted((tuple(r) for r in d.select(cols).collect()), key=str)
            assert rows(got) == rows(want)


def test_range_shift_matches_windows(spark):
    from gale.operators.scan import range_shift
    df = _data(spark)
    some = spark.createDataFrame([(1, 1.0, 5), (1, 2.0, 6), (2, 1.0, 7)], "g long, x double, v long")
    for rows, keys in ((df, ["g"]), (df, []), (some, ["g"]), (some, []), (df.limit(0), ["g"])):
        w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("x", "g")
        for k in (1, 4, -4):
            f = F.lead if k > 0 else F.lag
            want = sorted(((r.g, r.x, r.s) for r in rows.withColumn("s", f("v", abs(k)).over(w)).collect()), key=str)
            got = range_shift(rows, keys, ["x", "g"], ["v"], k, suffix="_s").collect()
            assert sorted(((r.g, r.x, r.v_s) for r in got), key=str) == want, (keys, k)


def test_a_crowded_day_spreads_over_the_partitions(spark):
    """90 % of all rows at one time: range partitions hold about equally many."""
    rows = spark.range(8000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(77)).alias("t"), "id")
    sizes = [r["count"] for r in rows.repartitionByRange(8, "t", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 8000 / 8


def test_with_lead_and_lag_match_window(spark):
    from gale.operators.scan import with_lead
    df = _data(spark)
    w = Window.partitionBy("g").orderBy("x")
    for k in (1, 4, -4):
        f = F.lead if k > 0 else F.lag
        want = {(r.g, r.x): r.l for r in df.withColumn("l", f("v", abs(k)).over(w)).collect()}
        for width in (None, 997.0, 5.0):
            out = with_lead(df, ["g"], ["x"], ["v"], k, suffix="_s", bucket_width=width)
            got = {(r.g, r.x): r.v_s for r in out.collect()}
            assert got == want, (k, width)
