"""End-to-end jobs on a synthetic education panel (FIXTURES F1/F4 shapes): training
(O3), batch scoring with the trained model (C6), drift (K5), reports (S10, S11)."""

import os

import pytest
from pyspark.sql import functions as F

from panelrisk.operators import model as ML
from panelrisk.operators.scoring import score_batch
from panelrisk.plans.jobs import drift_job, train_job
from panelrisk.session import scratch_path
from panelrisk.sources.registry import latest, load_model, read_registry
from panelrisk.sources.reports import drift_report, evaluation_report, write_report
from panelrisk.operators import metrics as M

IND = ["INDE", "IAN", "IDA", "IEG", "IAA", "IPS", "IPP", "IPV"]


def _u(i, salt, lo=2.0, hi=10.0):
    # deterministic pseudo-uniform in [lo, hi) from a hash of (row, salt)
    h = F.abs(F.xxhash64(F.col(i), F.lit(salt))) % 10000
    return F.round(F.lit(lo) + (F.lit(hi - lo) * h / 10000.0), 2)


def _panel(spark, n=450, shift=0.0):
    base = spark.range(n).select(
        F.concat(F.lit("ESTUDANTE_"), F.lpad((F.col("id") % 150).cast("string"), 3, "0")).alias("NOME"),
        (F.lit(2022) + (F.col("id") / 150).cast("int")).alias("ANO"),
        (F.abs(F.xxhash64("id", F.lit(1))) % 9).alias("FASE"),
        F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.abs(F.xxhash64("id", F.lit(2))) % 4 + 1).cast("int"))
        .alias("TURMA"),
        *[(_u("id", 10 + k) + F.lit(shift)).alias(c) for k, c in enumerate(IND)],
        (F.abs(F.xxhash64("id", F.lit(3))) % 2).alias("PONTO_DE_VIRADA"))
    return base


@pytest.fixture(scope="module")
def csv_path(spark):
    path = scratch_path(spark, "t-edu-csv")
    _panel(spark).coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    return path


@pytest.fixture(scope="module")
def trained(spark, csv_path):
    small = [ML.Candidate("RandomForestClassifier", lambda: ML.random_forest("DEFASAGEM", num_trees=8, max_depth=4)),
             ML.Candidate("GBTClassifier", lambda: ML.boosted_trees("DEFASAGEM", max_iter=4, max_depth=3))]
    model_path, reg = scratch_path(spark, "t-model"), scratch_path(spark, "t-registry")
    out = train_job(spark, csv_path, candidates=small, folds=3, model_path=model_path, registry_path=reg)
    return out, model_path, reg


def test_train_job(spark, trained):
    out, model_path, reg = trained
    assert out["panel"].count() == 450
    assert {"INDICE_BEMESTAR", "EVOLUCAO_INDE", "DEFASAGEM"} <= set(out["panel"].columns)
    assert out["leaderboard"].where("selected").count() == 1
    m = out["metrics"].first()
    assert 0.0 <= m.f1_macro <= 1.0 and m.roc_auc > 0.5
    assert out["gates"].count() == 4
    assert os.path.isdir(model_path)
    rec = latest(read_registry(spark, reg)).first()
    assert rec.version == "1.0.0" and "INDE" in rec.features and "f1_macro_mean" in rec.cv_scores


def test_score_batch_with_trained_model(spark, trained):
    _, model_path, _ = trained
    model = load_model(model_path)
    schema = ("student_id string, inde double, ian double, ida double, ieg double, iaa double, ips double, "
              "ipp double, ipv double, fase int, ano int, ponto_de_virada boolean")
    rows = [("ok", 6.5, 7.2, 6.8, 7.5, 7.0, 6.2, 6.9, 7.1, 3, 2024, True),
            ("risk", 3.0, 2.5, 3.0, 2.0, 3.0, 3.0, 2.0, 3.0, 2, 2024, None),
            ("bad", 15.0, 7.2, 6.8, 7.5, 7.0, 6.2, 6.9, 7.1, 3, 2024, False)]
    records, quarantine = score_batch(spark.createDataFrame(rows, schema), model)
    got = {r.student_id: r for r in records.collect()}
    assert set(got) == {"ok", "risk"}
    assert all(0.0 <= r.probabilidade <= 1.0 for r in got.values())
    assert got["risk"].probabilidade >= got["ok"].probabilidade
    assert [r.student_id for r in quarantine.collect()] == ["bad"]


def test_load_missing_model_raises(spark):
    with pytest.raises(FileNotFoundError):
        load_model(scratch_path(spark, "no-model"))


def test_drift_job_and_reports(spark, csv_path):
    raw = spark.read.option("header", True).option("sep", ";").option("inferSchema", True).csv(csv_path)
    per, summary = drift_job(raw, test="ks")
    s = summary.first()
    assert s.n_columns == per.count() and not s.drift_detected
    shifted = _panel(spark, shift=2.0)
    per2, summary2 = drift_job(raw, shifted, test="ks")
    s2 = summary2.first()
    assert s2.drift_detected and "INDE" in s2.drifted_features
    path = scratch_path(spark, "t-reports")
    write_report(drift_report(per2, summary2), path, "run-1")
    write_report(drift_report(per, summary), path, "run-2")
    back = spark.read.parquet(path)
    assert sorted(r.run_id for r in back.select("run_id").distinct().collect()) == ["run-1", "run-2"]


def test_evaluation_report(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.2), (1, 0, 0.4), (0, 1, 0.6)],
                               "label int, prediction int, score double")
    rep = evaluation_report(M.evaluate(df), M.release_gates(M.evaluate(df)), M.class_report(df),
                            M.confusion_matrix(df))
    sections = {r.section for r in rep.collect()}
    assert {"metrics", "gates", "confusion", "class_f1"} <= sections
