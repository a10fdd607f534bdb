"""Physical-plan properties that matter at scale, checked on every registered query."""

import os
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
HEAVY = {"cv_scores", "model_compare", "tune", "feature_importance", "train_score", "drift_job"}


def _plan(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString() + "\n" + qe.optimizedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: _plan(fn(spark, SF)) for name, fn in entry.queries().items()
            if name not in HEAVY and name not in entry.LLM_QUERIES}


def test_no_cross_joins(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_filters_reach_the_scan(spark):
    from panelrisk.operators.drift import _side_counts
    from panelrisk.plans.queries import LI_MEASURES, lineitem_halves
    li, cut = lineitem_halves(spark, SF)
    p = _plan(_side_counts(li.where(cut), li.where(~cut), LI_MEASURES, "double"))
    assert re.search(r"PushedFilters: \[[^\]]*l_shipdate", p)
    scans = re.findall(r"ReadSchema: struct<([^\n]*)", p)
    # pruned: only the four measures and the ship date are read
    assert scans and all(s.startswith("l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double")
                         and "l_orderkey" not in s for s in scans)


def test_split_drift_reads_the_table_once(spark):
    from panelrisk.operators.drift import _split_counts
    from panelrisk.plans.queries import LI_MEASURES, lineitem_halves
    p = _plan(_split_counts(*lineitem_halves(spark, SF), LI_MEASURES, "double"))
    scans = re.findall(r"ReadSchema: struct<([^\n]*)", p)
    assert len(scans) == 1 and "l_orderkey" not in scans[0] and "l_shipdate" in scans[0]


def test_sparse_filter_is_one_scan_without_shuffle(spark):
    df = entry.queries()["sparse_rows"](spark, SF)
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in physical and physical.count("FileScan") == 1
    assert "atleastnnonnulls" in physical.lower()


def test_top_k_only_where_it_is_the_feature(plans):
    limited = {n for n, p in plans.items() if "TakeOrderedAndProject" in p or "GlobalLimit" in p}
    # the latest-50 report and the registry's latest entry (max_by, no limit) ...
    assert limited <= {"recent_predictions"}


def test_ordered_windows_are_bucketed(plans):
    # every window that orders rows inside a segment partitions by the bucket id, so no
    # segment (a class, an entity, a column) is processed by a single task
    for name in ("lag_diff", "stratified_folds", "roc_curve"):
        wins = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plans[name])
        data_wins = [w for w in wins if "_bucket" in w or "_segkey" in w or w.strip()]
        assert any("_bucket" in w for w in data_wins), name


def test_splits_and_samples_shuffle_no_full_rows(spark):
    # every row is decided by its own hash: one scan, no exchange, no window
    for name in ("stratified_split", "exact_sample"):
        physical = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in physical and "Window" not in physical, name


def test_one_row_statistics_run_once(spark):
    # the fields of one scalars() aggregate share one subquery: using three of them runs
    # no more jobs than using one
    from pyspark.sql import functions as F

    from panelrisk.functions.columns import scalars
    sc = spark.sparkContext
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"))

    def jobs(n_fields, group):
        s = scalars(df.agg(F.max("a").alias("ma"), F.min("b").alias("mb"), F.sum("a").alias("sa")))
        cols = [(F.col("a") + s["ma"]).alias("x"), (F.col("b") * s["mb"]).alias("y"), (F.col("a") - s["sa"]).alias("z")]
        sc.setJobGroup(group, group)
        df.select(*cols[:n_fields]).write.format("noop").mode("overwrite").save()
        n = len(sc.statusTracker().getJobIdsForGroup(group))
        sc.setJobGroup("", "")
        return n

    assert jobs(3, "three-fields") <= jobs(1, "one-field")
