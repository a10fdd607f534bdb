"""Drift (K1-K4) against brute force, Spark ML modelling (A1-A13), stream = batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrisk.operators import model as ML
from panelrisk.operators.drift import categorical_drift, drift_summary, numeric_drift
from panelrisk.operators.sampling import stratified_folds
from panelrisk.session import scratch_path
from panelrisk.sources.files import PREDICTION_LOG_SCHEMA
from panelrisk.streaming.score_stream import counters_stream, counters_view, read_counters


def _ks_w1(a, b):
    xs = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    d = np.abs(fa - fb)
    return d.max(), float(np.sum(d[:-1] * np.diff(xs)))


def test_numeric_drift_brute_force(spark):
    rnd = random.Random(3)
    a = [round(rnd.gauss(0, 1), 2) for _ in range(400)]
    b = [round(rnd.gauss(0.8, 1), 2) for _ in range(300)]
    ref = spark.createDataFrame([(x,) for x in a], "x double")
    cur = spark.createDataFrame([(x,) for x in b], "x double")
    r = numeric_drift(ref, cur, ["x"]).first()
    ks, w1 = _ks_w1(np.array(a), np.array(b))
    assert r.ks_stat == pytest.approx(ks, abs=1e-12)
    assert r.wasserstein_norm == pytest.approx(w1 / np.std(a), rel=1e-9)
    assert r.p_value < 0.05 and r.drifted  # small reference -> KS rule
    same = numeric_drift(ref, ref, ["x"]).first()
    assert same.ks_stat == 0.0 and same.p_value == 1.0 and not same.drifted


def test_categorical_drift_and_summary(spark):
    ref = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "c string")
    cur = spark.createDataFrame([("a",)] * 90 + [("c",)] * 10, "c string")
    r = categorical_drift(ref, cur, ["c"]).first()
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.9, 0.0, 0.1])
    m = (p + q) / 2
    kl = lambda x: sum(xi * np.log(xi / mi) for xi, mi in zip(x, m) if xi > 0)
    assert r.js_distance == pytest.approx(np.sqrt(0.5 * kl(p) + 0.5 * kl(q)))
    assert r.n_categories == 3 and r.drifted
    rows = spark.createDataFrame([("x", True), ("y", False), ("z", False), ("w", False), ("v", False),
                                  ("u", False), ("t", False)], "column string, drifted boolean")
    s = drift_summary(rows).first()
    assert s.drift_score == round(1 / 7, 4) and s.drift_detected is False and s.drifted_features == ["x"]
    s2 = drift_summary(rows.limit(0)).first()
    assert s2.drift_score == 0.0 and s2.drift_detected is False


def test_standardize_and_one_hot(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, 3.0, "a"), (3, 3.0, "a")], "k int, x double, c string")
    s = {r.k: r.x_std for r in ML.standardize(df, ["x"]).collect()}
    mu, sd = 7 / 3, np.std([1.0, 3.0, 3.0])
    assert s[1] == pytest.approx((1 - mu) / sd)
    z = ML.standardize(df.withColumn("x", F.lit(2.0)), ["x"]).first()
    assert z.x_std == 0.0
    oh = ML.one_hot(df, "c")
    assert oh.columns == ["k", "x", "c", "c_a", "c_b"]
    assert {r.k: (r.c_a, r.c_b) for r in oh.collect()} == {1: (0.0, 1.0), 2: (1.0, 0.0), 3: (1.0, 0.0)}


def _panel(spark, n=240):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        a = rnd.random() * 10
        rows.append((i, a, rnd.random() * 10, "Sim" if rnd.random() < 0.5 else "Não", int(a < 4)))
    return spark.createDataFrame(rows, "id long, INDE double, IAN double, PONTO string, y int")


def test_train_predict_importance(spark):
    df = _panel(spark)
    model = ML.train(df, "y", ["INDE", "IAN"], ["PONTO"], ML.random_forest("y", num_trees=10, max_depth=4))
    scored = ML.with_probability(model.transform(df))
    probs = [r[ML.PROB1] for r in scored.select(ML.PROB1).collect()]
    assert all(0.0 <= p <= 1.0 for p in probs)
    imp = ML.feature_importance(model, scored, top_n=3).collect()
    assert imp[0].feature.endswith("INDE") or "INDE" in imp[0].feature
    assert [r.importance for r in imp] == sorted((r.importance for r in imp), reverse=True)


def test_cross_validate_and_compare(spark):
    df = stratified_folds(_panel(spark), "y", "id", k=3)
    cv = ML.cross_validate(df, "y", ["INDE", "IAN"], ["PONTO"],
                           classifier_factory=lambda: ML.random_forest("y", num_trees=5, max_depth=3)).first()
    assert cv.f1_macro_mean > 0.8 and cv.roc_auc_mean > 0.8 and cv.f1_macro_std >= 0.0
    board = ML.compare_models(df, "y", ["INDE", "IAN"], [], [
        ML.Candidate("rf", lambda: ML.random_forest("y", num_trees=5, max_depth=3)),
        ML.Candidate("bad", lambda: ML.random_forest("no_such_label"))]).collect()
    assert [(r.algorithm, r.selected) for r in sorted(board)] == [("rf", True), ("bad", False)]
    assert next(r.error for r in board if r.algorithm == "bad")


def test_param_grid_sample_seeded():
    g = {"a": [1, 2, 3], "b": [4, 5]}
    assert ML.param_grid_sample(g, 4, 42) == ML.param_grid_sample(g, 4, 42)
    assert len(ML.param_grid_sample(g, 10, 42)) == 6


def test_stream_counters_equal_batch(spark):
    rows = [("2024-01-01T00:00:0%d" % i, str(i), i, 1, 0.9, "alto" if i % 3 == 0 else "baixo") for i in range(9)]
    log = spark.createDataFrame(rows, PREDICTION_LOG_SCHEMA)
    src, table, ck = (scratch_path(spark, n) for n in ("t-log", "t-cnt", "t-ck"))
    log.write.json(src)
    counters_stream(spark, src, PREDICTION_LOG_SCHEMA, table, ck)
    v = counters_view(read_counters(spark, table)).first()
    assert (v.total, v.alto, v.ultima) == (9, 3, "2024-01-01T00:00:08")
    # a second file arrives: the restarted query resumes from its checkpoint
    log.limit(3).write.mode("append").json(src)
    counters_stream(spark, src, PREDICTION_LOG_SCHEMA, table, ck)
    assert counters_view(read_counters(spark, table)).first().total == 12


def test_split_drift_equals_two_frames(spark):
    import random

    from panelrisk.operators.drift import categorical_drift_split, numeric_drift_split
    rnd = random.Random(2)
    rows = [(rnd.choice([None, 1, 2, 3]), round(rnd.gauss(i % 3, 1), 2), rnd.choice(["a", "b", None, "c"]))
            for i in range(600)]
    df = spark.createDataFrame(rows, "side int, x double, c string")
    is_ref = F.col("side") <= 1
    ref, cur = df.where(is_ref), df.where(~is_ref)
    for two, one in [(numeric_drift(ref, cur, ["x"]), numeric_drift_split(df, is_ref, ["x"])),
                     (categorical_drift(ref, cur, ["c"]), categorical_drift_split(df, is_ref, ["c"]))]:
        a, b = two.first().asDict(), one.first().asDict()
        assert a.keys() == b.keys()
        assert all(a[k] == b[k] if not isinstance(a[k], float) else abs(a[k] - b[k]) < 1e-12 for k in a)
