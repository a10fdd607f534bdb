"""Scaler and imputer stages: statistics of the rows they are fitted on, saved with the pipeline."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from panelrisk.operators import model as ML
from panelrisk.operators.prep_stages import ImputerStage, PopulationScaler
from panelrisk.session import scratch_path

NAN = float("nan")


def _vectors(df, col="z"):
    return {r.i: list(r[col]) for r in df.select("i", col).collect()}


def test_population_scaler(spark):
    rows = [(0, 1.0, 5.0, None, 1.0), (1, 2.0, 5.0, None, NAN), (2, 4.0, 5.0, None, None), (3, None, 5.0, None, float("inf")),
            (4, NAN, 5.0, None, 3.0)]
    df = spark.createDataFrame(rows, "i int, `a.b` double, c double, d double, e double")
    cols = ["a.b", "c", "d", "e"]
    model = PopulationScaler(inputCols=cols, outputCol="z").fit(df)
    own = np.array([1.0, 2.0, 4.0])
    got = _vectors(model.transform(df))
    for i, x in enumerate(own):
        assert got[i][0] == pytest.approx((x - own.mean()) / own.std())
    assert [v[1] for v in got.values()] == [0.0] * 5 and all(math.isnan(v[2]) for v in got.values())
    assert math.isnan(got[3][0]) and math.isnan(got[4][0])
    assert got[0][3] == -1.0 and got[4][3] == 1.0 and math.isnan(got[1][3]) and got[3][3] == float("inf")
    path = scratch_path(spark, "scaler")
    model.save(path)
    again = type(model).load(path)
    assert repr(_vectors(again.transform(df))) == repr(got)
    assert PopulationScaler(inputCols=["c"], outputCol="z").fit(df.limit(0)).transform(df).count() == 5


def _panel(spark, n=240):
    rows = [(i, i % 4, None if i % 5 == 0 else float(i % 4 * 10 + i % 3), NAN if i % 7 == 0 else float(i % 11),
             None if i % 6 == 0 else "ab"[i % 2], int(i % 4 >= 2), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "i int, g int, x double, y double, t string, label int, fold int")


IMPUTE = dict(indicators=["x", "y", "absent"], group="g", categoricals=["t"])


def test_imputer_stage_keeps_the_statistics_of_its_fit(spark):
    train = spark.createDataFrame([(1, 1.0, 1.0, "a"), (1, 3.0, NAN, "a"), (2, 10.0, 4.0, "b"), (2, None, None, None)],
                                  "g int, x double, y double, t string")
    model = ImputerStage(**IMPUTE).fit(train)
    new = spark.createDataFrame([(0, 1, None, NAN, None), (1, 2, NAN, None, "c"), (2, 9, None, None, None), (3, None, None, 7.0, "b")],
                                "i int, g int, x double, y double, t string")
    want = {0: (2.0, 1.0, "a"), 1: (10.0, 4.0, "c"), 2: (6.5, 2.5, "a"), 3: (6.5, 7.0, "b")}
    path = scratch_path(spark, "imputer-stage")
    model.save(path)
    for m in (model, type(model).load(path)):
        assert m.transform(new).columns == new.columns
        assert {r.i: (r.x, r.y, r.t) for r in m.transform(new).collect()} == want
    bare = ImputerStage(indicators=["nothing"]).fit(train)
    bare.save(path + "-bare")
    assert type(bare).load(path + "-bare").transform(new).count() == 4
    assert ImputerStage(**IMPUTE).fit(train.limit(0)).transform(new).where("x is null").count() == 4


def test_pipeline_with_imputer_saves_and_reloads(spark):
    df = _panel(spark)
    forest = ML.random_forest("label", num_trees=5, max_depth=3)
    model = ML.train(df, "label", ["x", "y"], ["t"], forest, ImputerStage(**IMPUTE))
    path = scratch_path(spark, "pipeline-imputer")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert [type(s) for s in again.stages] == [type(s) for s in model.stages]
    assert ML.slot_names(again) == ["x", "y", "t_a", "t_b"]
    a, b = (_vectors(ML.with_probability(m.transform(df)), "probability") for m in (model, again))
    assert a == b and len(a) == 240
    assert not any(math.isnan(v) for f in _vectors(model.transform(df), "features").values() for v in f)
    spec = Pipeline(stages=[ImputerStage(**IMPUTE), PopulationScaler(inputCols=["x"], outputCol="z")])
    spec.save(path + "-unfitted")
    assert Pipeline.load(path + "-unfitted").getStages()[0].getOrDefault("group") == "g"


def test_each_fold_is_imputed_by_its_training_part(spark, monkeypatch):
    """The held-out part of a fold has other values: none of them may reach the statistics."""
    df = _panel(spark).withColumn("x", F.when(F.col("fold") == 0, F.col("x") + 1000).otherwise(F.col("x")))
    fitted, fit = [], ImputerStage._fit

    def noted(self, data):
        out = fit(self, data)
        fitted.append((sorted(r.fold for r in data.select("fold").distinct().collect()), out.fitted.global_tab.first()["x__a"]))
        return out

    monkeypatch.setattr(ImputerStage, "_fit", noted)
    out = ML.cross_validate(df, "label", ["x", "y"], ["t"], classifier_factory=lambda: ML.random_forest("label", num_trees=3, max_depth=3),
                            impute=ImputerStage(**IMPUTE)).first()
    assert [f for f, _ in fitted] == [[1, 2], [0, 2], [0, 1]]
    assert fitted[0][1] < 100 and 0 <= out.f1_macro_mean <= 1
