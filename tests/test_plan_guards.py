"""Physical-plan guards: no cartesian products or nested-loop joins."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

NAMES = ["change_24h", "change_24h_realtime", "exact_time_change", "case_features", "training_frame",
         "contingency_stats", "classification_report", "roc_curve_auc", "area_under_performance",
         "reliability_products", "consensus_reliability", "class_weights", "box_stats", "density_by_basin",
         "random_oversample", "stratified_folds", "ingest_case_diagnostics", "load_processed"]


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian(spark, name):
    df = E.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line and "ReusedExchange" not in line for line in plan.splitlines())


@pytest.fixture
def big(spark):
    """Plans as for tables too large to broadcast, before any adaptive change."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_exchange_bounds_of_operators(big):
    from gale.operators import features, series
    from gale.plans import q_features as Q
    from gale.plans import views as V
    hours = big.createDataFrame([], V.cases(big, SMALL).schema)
    cyc = big.createDataFrame([], V.cycles(big, SMALL).schema)
    assert _exchanges(series.change_24h(cyc, ["storm_id"], "DATE_full", ["VMAX"])) == 1
    assert _exchanges(series.track_change(cyc, ["storm_id"], "DATE_full")) == 1
    f = features.case_features(hours, Q.CASE, Q.F3_DYN, hours=Q.FORE, carry=["NAME", "DATE_full"],
                               factors=Q.F3_FACTORS, basin_col="BASIN", ir_slots=Q.IR_SLOTS, ir_names=Q.IR_NAMES,
                               pc_slots=Q.PC_SLOTS, pc_names=Q.PC_NAMES)
    assert _exchanges(f) == 1


def test_exchange_bounds_of_scans_and_curves(big):
    """Exchanges of the last step; earlier ones end in a checkpoint (counts of values, range-partitioned rows)."""
    from gale.operators import evaluate, explore, scan, series, verify
    from gale.plans import views as V
    cyc = big.createDataFrame([], V.cycles(big, SMALL).schema)
    pred = big.createDataFrame([], "m string, BASIN string, y int, p double")
    assert _exchanges(series.change_24h_realtime(cyc, "DATE_full", ["VMAX"], tiebreak=["storm_id"])) <= 3
    assert _exchanges(series.change_reverse(cyc, ["storm_id"], "DATE_full")) <= 3
    assert _exchanges(scan.range_shift(cyc, [], ["DATE_full", "storm_id"], ["VMAX"], 1, suffix="_n")) <= 3
    counts = verify.score_counts(pred, ["m"], "y", "p")
    cum = verify.cumulative_table(counts, ["m"])
    assert _exchanges(cum) <= 5 and _exchanges(verify.roc_curve(None, ["m"], cum=cum)) <= 5
    assert _exchanges(verify.area_under_performance(cum, ["m"])) <= 6
    assert _exchanges(explore.exact_quantiles(pred, ["m"], "p", {"q50": 0.5})) <= 3
    assert evaluate.CELLS > 1


def test_long_series_spreads_over_tasks(spark):
    """One storm with 90 % of the rows: no window partition holds much of it."""
    from pyspark.sql import functions as F

    from gale.operators import series
    rows = spark.range(7200).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("storm"),
                                    F.expr("timestamp_ntz '1980-01-01 00:00:00' + make_dt_interval(0, int(id * 6))").alias("t"),
                                    F.rand(1).alias("v"))
    plan = series.change_24h(rows, ["storm"], "t", ["v"])
    assert plan.count() == 720 * 5  # a partner four rows and 24 h later, unless one of the five rows is another storm's
    day = F.datediff(F.to_date("t"), F.lit("1970-01-01"))
    most = rows.groupBy("storm", F.floor(day / series.CHUNK_DAYS)).count().agg(F.max("count")).first()[0]
    assert most <= 4 * series.CHUNK_DAYS


def test_balanced_weights_do_not_shuffle_rows_by_class(big):
    from gale.operators import sampling
    rows = big.createDataFrame([(i, int(i % 10 == 0)) for i in range(100)], "k int, y int")
    out = sampling.balanced_weights(rows, "y")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(y" not in plan
    assert {(r.y, r.weight) for r in out.collect()} == {(0, 100 / 180), (1, 5.0)}


def test_weights_of_many_classes_are_not_broadcast(big):
    from gale.operators import sampling
    out = sampling.balanced_weights(big.range(sampling.MAX_CLASSES + 1), "id")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("weight = 1").count() == sampling.MAX_CLASSES + 1


def test_factor_lookup_groups_the_long_rows_once(big):
    plan = E.queries()["factor_lookup"](big, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate(") + plan.count("SortAggregate(") == 4  # the view's and the query's own, in two steps each
