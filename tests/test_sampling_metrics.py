"""Splits and samples (T1-T3) and evaluation metrics (E1-E7), checked by brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from panelrisk.operators import metrics as M
from panelrisk.operators.sampling import exact_sample, stratified_folds, stratified_split


def test_stratified_split(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    s = stratified_split(df, "y", "id")
    counts = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert counts[(1, "test")] == math.ceil(0.2 * 250) and counts[(0, "test")] == math.ceil(0.2 * 750)
    assert s.count() == 1000 and s.select("id").distinct().count() == 1000
    again = stratified_split(df, "y", "id")
    assert sorted(s.collect()) == sorted(again.collect())  # reproducible


def test_split_requires_label(spark):
    with pytest.raises(ValueError):
        stratified_split(spark.range(3), "y", "id")


def test_folds_balanced(spark):
    df = spark.range(100).withColumn("y", (F.col("id") < 30).cast("int"))
    f = stratified_folds(df, "y", "id", k=5)
    per = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    assert all(per[(1, k)] == 6 and per[(0, k)] == 14 for k in range(5))


def test_exact_sample(spark):
    assert exact_sample(spark.range(1001), "id", 0.3).count() == round(0.3 * 1001)


def _preds(spark, n=300, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.3)
        s = round(min(1.0, max(0.0, rnd.gauss(0.35 + 0.3 * y, 0.2))), 1)  # many ties
        rows.append((i, y, s, int(s >= 0.5)))
    return rows, spark.createDataFrame(rows, "id int, label int, score double, prediction int")


def test_auc_matches_pairwise(spark):
    rows, df = _preds(spark)
    pos = [r[2] for r in rows if r[1] == 1]
    neg = [r[2] for r in rows if r[1] == 0]
    want = sum((p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert M.roc_auc(df).first().roc_auc == pytest.approx(want, abs=1e-12)
    by = {r.g: r.roc_auc for r in M.roc_auc_by(df.withColumn("g", F.col("id") % 2), ["g"]).collect()}
    assert set(by) == {0, 1}


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.7)], "label int, score double")
    assert M.roc_auc(df).first().roc_auc is None


def test_roc_curve_points(spark):
    rows, df = _preds(spark)
    curve = {r.threshold: (r.fpr, r.tpr) for r in M.roc_curve(df).collect()}
    P = sum(r[1] for r in rows)
    N = len(rows) - P
    for t in (0.2, 0.5, 0.8):
        if t in curve:
            tp = sum(1 for r in rows if r[1] == 1 and r[2] >= t)
            fp = sum(1 for r in rows if r[1] == 0 and r[2] >= t)
            assert curve[t] == pytest.approx((fp / N, tp / P))


def test_confusion_report_and_summary(spark):
    # class 2 is never predicted -> precision 0 by zero-division rule
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 1)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    cm = {(r.actual, r.predicted): r.n for r in M.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (0, 2): 0, (1, 0): 1, (1, 1): 1, (1, 2): 0,
                  (2, 0): 0, (2, 1): 1, (2, 2): 0}
    rep = {r.cls: r for r in M.class_report(df).collect()}
    assert rep[0].precision == pytest.approx(2 / 3) and rep[0].recall == pytest.approx(2 / 3)
    assert rep[2].precision == 0.0 and rep[2].f1 == 0.0 and rep[2].support == 1
    s = M.summary_metrics(df).first()
    f1 = [2 / 3, 0.4, 0.0]
    assert s.f1_macro == pytest.approx(sum(f1) / 3)
    assert s.f1_weighted == pytest.approx((3 * f1[0] + 2 * f1[1]) / 6)
    assert s.recall_positiva == pytest.approx(0.5) and s.accuracy == pytest.approx(0.5)


@pytest.mark.parametrize("f1,auc,rec,ok", [(0.70, 0.75, 0.65, True), (0.69, 0.9, 0.9, False),
                                           (0.9, 0.74, 0.9, False), (0.9, 0.9, 0.64, False)])
def test_release_gates_inclusive(spark, f1, auc, rec, ok):
    m = spark.createDataFrame([(f1, auc, rec)], "f1_macro double, roc_auc double, recall_positiva double")
    g = {r.metric: r.passed for r in M.release_gates(m).collect()}
    assert g["all"] is ok


def test_release_gates_missing_metric_is_zero(spark):
    m = spark.createDataFrame([(0.9, 0.9)], "f1_macro double, roc_auc double")
    g = {r.metric: (r.value, r.passed) for r in M.release_gates(m).collect()}
    assert g["recall_positiva"] == (0.0, False) and g["all"][1] is False
