"""Invariants of the resampling operators and stream/batch equivalence."""

from pyspark.sql import functions as F

from gale.operators import clean, sampling
from gale.plans import views as V
from tests.conftest import SMALL


def _rows(spark):
    return V.scored(spark, SMALL).select("case_key", "y_true")


def test_folds_partition_and_balance(spark):
    df = _rows(spark)
    f = sampling.stratified_folds(df, "case_key", "y_true", 10)
    assert f.count() == df.count()
    assert f.select("case_key").distinct().count() == df.select("case_key").distinct().count()
    sizes = f.groupBy("y_true", "fold").count().groupBy("y_true").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r.spread <= 1 for r in sizes)


def test_oversample_exact_count(spark):
    df = _rows(spark)
    counts = {r.y_true: r["count"] for r in df.groupBy("y_true").count().collect()}
    out = sampling.random_oversample(df, "case_key", "y_true", 1, 0.7)
    got = {r.y_true: r["count"] for r in out.groupBy("y_true").count().collect()}
    assert got[0] == counts[0]
    assert got[1] == max(counts[1], int(0.7 * counts[0]))


def test_undersample_matches_minority(spark):
    df = _rows(spark)
    out = sampling.random_undersample(df, "case_key", "y_true", 1)
    got = {r.y_true: r["count"] for r in out.groupBy("y_true").count().collect()}
    assert got[0] == got[1]


def test_year_draws_disjoint_from_training(spark):
    k = V.case_keys(spark, SMALL)
    draws = sampling.year_draws(k, "YEAR", 5, 3, seed=1).collect()
    by_draw = {}
    for r in draws:
        by_draw.setdefault(r.draw, set()).add(r.year)
    assert all(len(v) == 3 for v in by_draw.values())
    held = sorted(by_draw[0])
    train, test = clean.split_by_year(k, held, year_col="YEAR")
    assert not ({r.YEAR for r in train.select("YEAR").distinct().collect()} & set(held))
    assert train.count() + test.count() == k.count()


def test_stream_join_equals_batch_join(spark):
    from gale.operators import series
    from gale.sources.results import shared_path
    from gale.streaming import jobs
    cyc = V.cycles(spark, SMALL).select("storm_id", "DATE_full", "VMAX")
    src = shared_path(spark, "t-stream")
    cyc.withColumn("day", F.to_date("DATE_full")).write.partitionBy("day").parquet(src)
    s = jobs.stream_verify_24h(spark, src + "/*", "storm_id bigint, DATE_full timestamp_ntz, VMAX double",
                               watermark="30 hours")
    b = series.exact_time_change(cyc, ["storm_id"], "DATE_full").where(F.col("d_V").isNotNull())
    key = ["storm_id", "DATE_full", "d_V"]
    assert sorted(map(tuple, s.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))


def test_cycle_counts_whatever_the_file_order(spark):
    """Days written newest first, one file each, as a folder: no event is lost; nothing at all is fine too."""
    from gale.sources.results import shared_path
    from gale.sources.tables import read_table
    from gale.streaming import jobs
    ev = read_table(spark, SMALL, "events")
    days = [r[0] for r in ev.select(F.to_date("ts").alias("d")).distinct().orderBy(F.desc("d")).collect()]
    src = shared_path(spark, "t-days")
    for d in days[:8]:
        ev.where(F.to_date("ts") == d).coalesce(1).write.mode("append").parquet(src)
    want = ev.where(F.to_date("ts").isin(days[:8])).count()
    got = jobs.stream_cycle_counts(spark, src, ev.schema, watermark="30 hours").agg(F.sum("n")).first()[0]
    assert got == want
    empty = shared_path(spark, "t-empty")
    ev.limit(0).write.parquet(empty)
    assert jobs.stream_cycle_counts(spark, empty, ev.schema, watermark="30 hours").count() == 0


def test_twenty_batches_with_a_restart_and_late_rows(spark):
    """20 files, one a batch, the job started again in the middle: the batch answer; late rows are listed, none is lost."""
    import datetime as dt

    from gale.operators import series
    from gale.plans import render
    from gale.sources.results import shared_path
    from gale.streaming import jobs
    cyc = V.cycles(spark, SMALL).select("storm_id", "DATE_full", "VMAX")
    days = sorted(r[0] for r in cyc.select("DATE_full").distinct().collect())
    cyc = cyc.where(F.col("DATE_full") < F.lit(days[0] + dt.timedelta(days=20)))
    schema = "storm_id bigint, DATE_full timestamp_ntz, VMAX double"
    first = F.col("DATE_full") < F.lit(days[0] + dt.timedelta(days=10))
    src, work = shared_path(spark, "t-arrive"), shared_path(spark, "t-work")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def arrive(rows, files):
        part = render.write_arrivals(rows, "DATE_full", "t-part", files)
        fs = hadoop.Path(part).getFileSystem(conf)
        fs.mkdirs(hadoop.Path(src))
        for s in fs.listStatus(hadoop.Path(part)):
            if s.getPath().getName().startswith("part-"):
                fs.rename(s.getPath(), hadoop.Path(f"{src}/{s.getPath().getName()}"))
    job = lambda: jobs.stream_verify_24h(spark, src, schema, watermark="30 hours", files_per_batch=1, work=work)
    arrive(cyc.where(first), 10)
    half = job().count()
    late = [(1, days[0], 99.0), (2, None, 98.0)]
    arrive(cyc.where(~first), 10)
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(src)
    got = job()
    want = series.exact_time_change(cyc, ["storm_id"], "DATE_full").where(F.col("d_V").isNotNull()).select("storm_id", "DATE_full", "d_V")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and 0 < half < want.count()
    rows = jobs.late_rows(spark, work, jobs._struct(schema)).collect()
    assert sorted((r["storm_id"], r["VMAX"]) for r in rows) == [(1, 99.0), (2, 98.0)] and {r["batch"] for r in rows} == {20}


def test_late_events_are_listed_and_not_counted(spark):
    from gale.plans import render
    from gale.sources.results import shared_path
    from gale.sources.tables import read_table
    from gale.streaming import jobs
    ev = read_table(spark, SMALL, "events")
    work, src = shared_path(spark, "t-late"), render.write_arrivals(ev, "ts", "t-events", 6)
    ev.orderBy("ts").limit(5).coalesce(1).write.mode("append").parquet(src)  # the five oldest once more, last of all
    got = jobs.stream_cycle_counts(spark, src, ev.schema, watermark="30 hours", files_per_batch=1, work=work)
    assert got.agg(F.sum("n")).first()[0] == ev.count() and jobs.late_rows(spark, work, ev.schema).count() == 5


def test_record_stream_to_features_equals_batch(spark):
    import __spark_entry__ as E
    a, b = (E.queries()[q](spark, SMALL) for q in ("stream_case_features", "case_features"))
    assert sorted(map(tuple, a.select(b.columns).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_permutation_importance_constant_feature(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from gale.operators.models import permutation_importance
    rows = [(i, float(i % 10), 1.0, float(i % 10 >= 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x double, c double, label double")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x", "c"], outputCol="features"),
                            LogisticRegression(labelCol="label")]).fit(df)
    imp = {r.feature: r.mean_importance for r in
           permutation_importance(pipe, df, ["k"], ["x", "c"], "label", repeats=2).where("scope = 'ALL'").collect()}
    assert imp["c"] == 0.0 and imp["x"] > 0.2


def test_record_stream_does_not_store_the_parsed_rows(spark):
    """The chain of a micro-batch reads the record source itself; hours of all cases are many times the files."""
    from gale.plans import render
    from gale.streaming import jobs
    plans = []

    def chain(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.where("TIME = 0")
    got = jobs.stream_ingest_cases(spark, render.write_case_records(spark, SMALL), ["VMAX"], transform=chain)
    assert got.count() > 0 and len(plans) > 1 and all("BatchScan case_records" in p for p in plans)


def test_the_four_searches_share_their_folds(spark, monkeypatch):
    from gale.operators import models
    from gale.plans import q_models as Q
    rows = spark.createDataFrame([(i, int(i % 4 == 0), *[float(i * 7 % (11 + j)) for j in range(len(Q._FEATS))]) for i in range(120)],
                                 "case_id long, I_class int, " + ", ".join(f"{f} double" for f in Q._FEATS))
    dealt, seen, deal = [], [], models.stratified_folds
    monkeypatch.setattr(models, "stratified_folds", lambda *a, **k: dealt.append(a) or deal(*a, **k))
    monkeypatch.setattr(models, "grid_search", lambda *a, parts, whole=None, **k: seen.append((parts, [(p.count(), h.count()) for p, h in parts], whole)))
    Q._four_models(rows)
    assert len(dealt) == 1 and [len(n) for _, n, _ in seen] == [3] * 4
    assert seen[0][0] is seen[1][0] and seen[0][2] is seen[1][2] and seen[0][2].count() == 120
    assert seen[0][1] == [(80, 40)] * 3 and all(p > 80 and h == 40 for _, n, _ in seen[2:] for p, h in n)
