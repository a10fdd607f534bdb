"""The registered model queries ask for the sizes of the reference."""

import pytest

from panelrisk.operators import model as ML
from panelrisk.operators import trees
from panelrisk.plans import queries as Q

SF = "/root/testdata/sf0.001"


class Made(ValueError):
    pass


@pytest.fixture
def made(monkeypatch):
    out = []

    def fit_all(rows, tasks, *a):
        out.extend(tasks)
        raise Made

    monkeypatch.setattr(trees, "fit_all", fit_all)
    monkeypatch.setattr(trees, "cross_scores", fit_all)
    return out


@pytest.mark.parametrize("name,folds", [("train_score", [None]), ("feature_importance", [None]), ("cv_scores", [0, 1, 2, 3, 4])])
def test_default_forest(spark, made, name, folds):
    with pytest.raises(Made):
        Q.QUERIES[name](spark, SF).collect()
    assert [t.left_out for t in made] == folds
    assert {(t.spec.trees, t.spec.depth, t.spec.min_split, t.spec.features, t.spec.balanced) for t in made} == {(200, 10, 5, "sqrt", True)}


def test_compared_models(spark, made):
    with pytest.raises(Made):
        Q.QUERIES["model_compare"](spark, SF).collect()
    forest, level, leaf = made[0].spec, made[5].spec, made[10].spec
    assert len(made) == 15 and (forest.trees, forest.depth, forest.min_split) == (200, 10, 5)
    assert [(b.rounds, b.depth, b.step) for b in (level, leaf)] == [(200, 6, 0.1)] * 2
    assert (level.leaves, leaf.leaves, level.weights, leaf.weights) == (None, 31, "positive", "balanced")


def test_search(spark, made):
    with pytest.raises(Made):
        Q.QUERIES["tune"](spark, SF).collect()
    assert len(made) == 30 and {t.left_out for t in made} == {0, 1, 2}
    assert len(ML.param_grid_sample(Q.FOREST_GRID, 1000)) == 360
    assert {t.spec.trees for t in made} <= {100, 200, 300, 500} and {t.spec.depth for t in made} <= {5, 8, 10, 15, None}


@pytest.mark.parametrize("split,leaf", [(2, 1), (5, 1), (10, 2), (5, 4)])
def test_min_split(spark, split, leaf):
    forest = ML.random_forest("y", min_split=split, min_instances=leaf)
    assert (forest.getMinSplit(), forest.getMinInstancesPerNode()) == (split, leaf)
