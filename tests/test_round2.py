"""Rows without a key, odd numbers, absent fields, broken lines, streams with a model."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelrisk.operators import drift as D
from panelrisk.operators import metrics as M
from panelrisk.operators import model as ML
from panelrisk.operators.panel import YearlyColumn, yearly_columns
from panelrisk.operators.sampling import exact_sample, stratified_folds, stratified_split
from panelrisk.operators.scoring import EDUCATION_CONTRACT, score_batch, serving_features, validate_requests
from panelrisk.session import checkpoint_root, scratch_path
from panelrisk.sources.files import PREDICTION_LOG_SCHEMA, read_jsonl
from panelrisk.streaming.score_stream import counters_stream, counters_view, read_counters, score_requests_stream


def test_rows_without_a_key_stay(spark):
    df = spark.range(100).select(F.when(F.col("id") >= 10, F.col("id")).alias("k"), (F.col("id") % 2).alias("y"),
                                 F.col("id").alias("row"))
    split = stratified_split(df, "y", "k", 0.2).collect()
    assert sorted(r.row for r in split) == list(range(100)) and sum(r.split == "test" for r in split) == 20
    folds = stratified_folds(df, "y", "k", 5).groupBy("y", "fold").count().collect()
    assert len(folds) == 10 and {r["count"] for r in folds} == {10}
    assert exact_sample(df, "k", 0.3).count() == 30
    same = spark.range(50).select(F.lit(None).cast("long").alias("k"), F.lit(1).alias("y"))
    assert exact_sample(same, "k", 0.3).count() == 15


def drift(spark, ref, cur, **kw):
    a = spark.createDataFrame([(x,) for x in ref], "x double")
    b = spark.createDataFrame([(x,) for x in cur], "x double")
    return D.numeric_drift(a, b, ["x"], **kw).first()


def test_drift_on_odd_numbers(spark):
    nan = float("nan")
    r = drift(spark, [1.0, 2.0, nan, None], [1.0, 2.0, nan])
    assert (r.n_ref, r.n_cur, r.ks_stat, r.wasserstein_norm, r.drifted) == (2, 2, 0.0, 0.0, False)
    for ref, cur in (([1.0], [None]), ([nan], [2.0]), ([], [1.0]), ([None], [nan])):
        r = drift(spark, ref, cur)
        assert r.p_value is None and not r.drifted
    near = [math.sin(i) for i in range(400)]
    far = [x + 0.5 for x in near]
    want = drift(spark, near, far)
    got = drift(spark, [x + 1e9 for x in near], [x + 1e9 for x in far])
    assert got.drifted and abs(got.wasserstein_norm - want.wasserstein_norm) < 1e-4
    assert drift(spark, near, far, test="ks").drifted
    with pytest.raises(ValueError):
        drift(spark, near, far, test="other")
    empty = spark.createDataFrame([], "c string")
    full = spark.createDataFrame([("a",), ("b",)], "c string")
    r = D.categorical_drift(full, empty, ["c"]).first()
    assert r.js_distance is None and not r.drifted


def test_metrics_read_the_predictions_once(spark):
    sc = spark.sparkContext
    seen = sc.accumulator(0)
    rows = [(i % 3, (i * 7) % 3, (i % 10) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "label int, prediction int, score double")

    def count(stream):
        for b in stream:
            seen.add(b.num_rows)
            yield b

    for f in (M.confusion_matrix, M.class_report, M.summary_metrics, M.evaluate):
        seen.value = 0
        f(df.mapInArrow(count, df.schema)).collect()
        assert seen.value == 300, f.__name__


def test_yearly_names():
    assert YearlyColumn.parse("INDE_2021") == YearlyColumn("INDE_2021", "INDE", 2021)
    for name in ("INDE", "INDE_21", "INDE2021", "2021", "INDE_20211"):
        assert YearlyColumn.parse(name) is None
    assert list(yearly_columns(["B_2022", "A_2020", "A_2022"])) == [2020, 2022]


def test_absent_request_fields(spark):
    cols = ", ".join(f"{r.column} double" for r in EDUCATION_CONTRACT)
    good = spark.createDataFrame([tuple(2021.0 if r.column == "ano" else 5.0 for r in EDUCATION_CONTRACT)], cols)
    r = validate_requests(good).first()
    assert r.valid and r.student_id is None and r.ponto_de_virada is False
    assert serving_features(validate_requests(good)).first()["PONTO_DE_VIRADA"] == "Não"
    r = validate_requests(good.drop("ida")).first()
    assert not r.valid and list(r.errors) == ["ida: required"]


def test_full_mode_uses_the_history(spark):
    names = ["INDE", "IAN", "IDA", "IEG", "IAA", "IPS", "IPP", "IPV"]
    past = [("a", 2020, *[4.0] * 8), ("a", 2021, *[6.0] * 8), ("b", 2021, *[8.0] * 8)]
    history = spark.createDataFrame(past, "NOME string, ANO int, " + ", ".join(f"{n} double" for n in names))
    asked = [("a", 2022, 5.0), ("a", 2021, 7.0), ("c", 2022, 5.0)]
    req = spark.createDataFrame([(s, y, 3, False, *[v] * 8) for s, y, v in asked],
                                "student_id string, ano int, fase int, ponto_de_virada boolean, "
                                + ", ".join(f"{n.lower()} double" for n in names))
    out = {(r.student_id, r.ANO): r for r in serving_features(req, "full", history).collect()}
    assert len(out) == 3
    assert out["a", 2022].EVOLUCAO_INDE == -1.0 and out["a", 2021].EVOLUCAO_INDE == 3.0 and out["c", 2022].EVOLUCAO_INDE == 0.0
    assert out["a", 2022].ABAIXO_MEDIA_GERAL == 1 and out["a", 2021].ABAIXO_MEDIA_GERAL == 0
    assert all(r.EVOLUCAO_INDE == 0.0 for r in serving_features(req).collect())
    with pytest.raises(ValueError):
        serving_features(req, "full")


def test_broken_lines_in_batch_and_stream(spark):
    lines = ['{"nivel_risco": "alto", "timestamp": "2024-01-01"}', "{oops", "", '{"nivel_risco": "baixo"}']
    src, table, ck = (scratch_path(spark, n) for n in ("r2-log", "r2-cnt", "r2-ck"))
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(src)
    log = read_jsonl(spark, src, PREDICTION_LOG_SCHEMA)
    assert log.count() == 2
    assert read_jsonl(spark, src, PREDICTION_LOG_SCHEMA, keep_corrupt=True).where("_corrupt_record is not null").count() == 1
    assert read_jsonl(spark, src + "-none", PREDICTION_LOG_SCHEMA).count() == 0
    counters_stream(spark, src, PREDICTION_LOG_SCHEMA, table, ck)
    v = counters_view(read_counters(spark, table)).first()
    assert (v.total, v.alto) == (2, 1)


def test_stream_with_a_model_equals_batch(spark):
    fields = [r.column for r in EDUCATION_CONTRACT]
    rows = [(f"s{i}", *[2022.0 if c == "ano" else float((i * 7 + k) % 9) for k, c in enumerate(fields)], i % 2 == 0) for i in range(40)]
    rows.append(("bad", *[99.0] * len(fields), True))
    schema = "student_id string, " + ", ".join(f"{c} double" for c in fields) + ", ponto_de_virada boolean"
    req = spark.createDataFrame(rows, schema)
    train = serving_features(req.where("student_id <> 'bad'")).withColumn("y", (F.col("INDE") < 4).cast("int"))
    model = ML.train(train, "y", ["INDE", "IAN"], ["PONTO_DE_VIRADA"], ML.random_forest("y", num_trees=3, max_depth=3))
    now = F.lit(datetime(2024, 1, 1))
    features = ["INDE", "IAN", "PONTO_DE_VIRADA"]
    want, rejected = score_batch(req, model, now=now, features=features)
    src, sink, bad, ck = (scratch_path(spark, n) for n in ("r2-req", "r2-out", "r2-bad", "r2-ck2"))
    req.select(F.to_json(F.struct(*req.columns)).alias("value")).write.text(src)
    score_requests_stream(spark, src, req.schema, model, sink, bad, ck, now=now, features=features)
    got = spark.read.parquet(sink).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 40
    assert [r.student_id for r in spark.read.parquet(bad).collect()] == [r.student_id for r in rejected.collect()] == ["bad"]


def test_tuning_refits_the_best_point(spark):
    df = spark.range(120).select(F.col("id"), (F.col("id") % 10).cast("double").alias("a"), ((F.col("id") % 10) > 4).cast("int").alias("y"))
    folds = stratified_folds(df, "y", "id", k=2)
    grid = {"num_trees": [3], "max_depth": [2, None], "max_features": ["sqrt", "all"]}
    board, model = ML.tune_and_fit(folds, "y", ["a"], [], grid, n_iter=3)
    rows = board.collect()
    assert len(rows) == 3 and rows[0].f1_macro_mean >= rows[-1].f1_macro_mean
    assert model.transform(df).where("prediction = y").count() == 120


def test_scratch_folder_on_a_cluster_must_be_named():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        checkpoint_root(Session())


def test_imputer_survives_saving(spark):
    from panelrisk.operators.clean import PanelImputer, PanelImputerModel
    rows = [(1.0, 1.0, "a"), (1.0, 3.0, None), (2.0, None, "a"), (None, 7.0, "b")]
    df = spark.createDataFrame(rows, "g double, v double, c string")
    for group in ("g", None):
        model, path = PanelImputer(["v"], group, ["c"]).fit(df), scratch_path(spark, "imputer")
        model.save(path)
        again = PanelImputerModel.load(spark, path)
        odd = spark.createDataFrame([(1.0, None, None), (9.0, None, "z")], df.schema)
        assert sorted(map(tuple, again.transform(odd).collect())) == sorted(map(tuple, model.transform(odd).collect()))
