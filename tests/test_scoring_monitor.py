"""Scoring contract (C1-C5), log monitoring (U1-U4), file sources."""

import os

import pytest
from pyspark.sql import functions as F

from panelrisk.functions.columns import risk_tier
from panelrisk.operators.monitor import kpis, log_summary, recent_predictions
from panelrisk.operators.scoring import EDUCATION_CONTRACT, recode_turning_point, score_records, validate_requests
from panelrisk.session import scratch_path
from panelrisk.sources.files import PREDICTION_LOG_SCHEMA, load_csv, read_jsonl, write_csv
from panelrisk.sources.registry import REGISTRY_SCHEMA, latest, model_metadata, run_record

REQ = ("student_id string, inde double, ian double, ida double, ieg double, iaa double, ips double, "
       "ipp double, ipv double, fase int, ano int, ponto_de_virada boolean")
OK = ["s", 6.5, 7.2, 6.8, 7.5, 7.0, 6.2, 6.9, 7.1, 3, 2024, None]


@pytest.mark.parametrize("field,value,msg", [
    ("inde", 15.0, "inde: above 10"), ("inde", -1.0, "inde: below 0"), ("fase", -1, "fase: below 0"),
    ("fase", 9, "fase: above 8"), ("ano", 2019, "ano: below 2020"), ("ian", 11.0, "ian: above 10"),
    ("inde", None, "inde: required")])
def test_contract_violations(spark, field, value, msg):
    names = [c.split()[0] for c in REQ.split(", ")]
    row = list(OK)
    row[names.index(field)] = value
    out = validate_requests(spark.createDataFrame([tuple(OK), tuple(row)], REQ), EDUCATION_CONTRACT).collect()
    assert out[0].valid and out[0].errors == [] and out[0].ponto_de_virada is False
    assert not out[1].valid and out[1].errors == [msg]


@pytest.mark.parametrize("p,tier,risk", [(0.10, "baixo", False), (0.3999, "baixo", False), (0.40, "medio", False),
                                         (0.50, "medio", True), (0.70, "medio", True), (0.7001, "alto", True),
                                         (0.85, "alto", True)])
def test_tiers_and_decision(spark, p, tier, risk):
    df = spark.createDataFrame([("a", p)], "student_id string, probability double")
    r = score_records(df, now=F.lit("2024-01-01 00:00:00").cast("timestamp")).first()
    assert r.nivel_risco == tier and r.risco_defasagem is risk and r.modelo_versao == "1.0.0"


def test_round_half_up_on_display(spark):
    df = spark.createDataFrame([("a", 0.12345)], "student_id string, probability double")
    assert score_records(df).first().probabilidade == 0.1235


def test_turning_point_recode(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r.t for r in df.select(recode_turning_point(F.col("b")).alias("t")).collect()] == ["Sim", "Não", None]
    assert spark.range(1).select(risk_tier(F.lit(None).cast("double")).alias("t")).first().t is None


def _log(spark):
    rows = [("2024-01-02T10:00:00", "a", 1, 1, 0.9, "alto"), ("2024-01-03T09:00:00", "b", 2, 0, 0.2, "baixo"),
            ("", "c", 3, 0, 0.5, None), (None, "d", 4, 1, 0.8, "alto")]
    return spark.createDataFrame(rows, PREDICTION_LOG_SCHEMA)


def test_log_summary_and_kpis(spark):
    s = log_summary(_log(spark)).first()
    assert (s.total, s.alto, s.baixo_medio, s.ultima) == (4, 2, 2, "2024-01-03T09:00:00")
    k = kpis(log_summary(_log(spark))).first()
    assert k.taxa_risco == 0.5
    empty = spark.createDataFrame([], PREDICTION_LOG_SCHEMA)
    e = kpis(log_summary(empty)).first()
    assert (e.total_predicoes, e.predicoes_alto_risco, e.taxa_risco, e.ultima_predicao) == (0, 0, None, None)


def test_recent_predictions(spark):
    top = recent_predictions(_log(spark), 2, tie="event_id").collect()
    assert [r.student_id for r in top] == ["b", "a"]


def test_jsonl_lenient(spark, tmp_path):
    p = tmp_path / "log"
    p.mkdir()
    (p / "part.json").write_text('{"timestamp": "t1", "nivel_risco": "alto"}\n\n{broken\n'
                                 '{"timestamp": "t2", "nivel_risco": "baixo"}\n', encoding="utf-8")
    df = read_jsonl(spark, str(p), PREDICTION_LOG_SCHEMA)
    assert sorted(r.timestamp for r in df.collect()) == ["t1", "t2"]
    assert read_jsonl(spark, str(tmp_path / "missing"), PREDICTION_LOG_SCHEMA).count() == 0


def test_csv_latin1_fallback_and_errors(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_bytes("NOME;PONTO\nJoão;Não\n".encode("latin-1"))
    df = load_csv(spark, str(f), sep=";")
    assert df.first().asDict() == {"NOME": "João", "PONTO": "Não"}
    u = tmp_path / "u.csv"
    u.write_text("NOME;PONTO\nJoão;Não\n", encoding="utf-8")
    assert load_csv(spark, str(u), sep=";").first().NOME == "João"
    h = tmp_path / "h.csv"
    h.write_text("NOME;PONTO\n", encoding="utf-8")
    with pytest.raises(ValueError):
        load_csv(spark, str(h), sep=";")
    with pytest.raises(FileNotFoundError):
        load_csv(spark, str(tmp_path / "nope.csv"))


def test_csv_roundtrip_comma(spark):
    path = scratch_path(spark, "t-csv")
    df = spark.createDataFrame([(1, "a", 2.5)], "k int, s string, v double")
    write_csv(df, path, sep=",")
    assert load_csv(spark, path, sep=",").first().asDict() == {"k": 1, "s": "a", "v": 2.5}
    assert os.path.isdir(path)


def test_registry_latest(spark):
    df = spark.createDataFrame([("v1", "2024-01-01"), ("v2", "2024-03-01"), ("v3", "2024-02-01")],
                               "version string, trained_at string").withColumn("trained_at", F.to_timestamp("trained_at"))
    assert latest(df).first().version == "v2"
    assert latest(df.limit(0)).count() == 0


def test_model_metadata_default_and_latest(spark):
    empty = spark.createDataFrame([], REGISTRY_SCHEMA)
    d = model_metadata(empty).first()
    assert d.version == "desconhecida" and d.features == []
    reg = run_record(spark, "2.0.0", "rf", ["INDE"], {"f1_macro_mean": 0.9}, {"f1_macro": 0.8}, True, "/m")
    assert model_metadata(reg, "/m").first().version == "2.0.0"
