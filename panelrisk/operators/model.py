"""Modelling on Spark ML.

Scaling, encoding and trees are Spark ML stages, fitted on executors; the only
driver-side pieces are model objects, the small parameter grid and per-fold metric
scalars.  Cross-validation folds come from ``sampling.stratified_folds``.

Forests and boosted trees are ``tree_stages.TreeClassifier``: all folds and candidates of a comparison or search
are fitted in the same jobs (``trees.cross_scores``).  Any other Spark ML classifier is fitted fold by fold.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.columns import scalars
from panelrisk.operators import trees
from panelrisk.operators.label import with_weight_column
from panelrisk.operators.metrics import cv_summary, per_group_metrics, roc_auc_by
from panelrisk.operators.prep_stages import PopulationScaler, PopulationScalerModel
from panelrisk.operators.tree_stages import KEY, TreeClassifier, row_hash
from panelrisk.session import materialize, ship

FEATURES = "features"
PROB1 = "probability_1"


# ---------------------------------------------------------------- SQL-form transforms
def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_std") -> DataFrame:
    """A1: (x - mean) / population std; zero variance -> 0 (sklearn semantics).

    Statistics are one aggregate row, used as scalar subqueries.
    """
    st = scalars(df.agg(*[F.avg(c).alias(f"{c}__mu") for c in cols],
                        *[F.stddev_pop(c).alias(f"{c}__sd") for c in cols]))
    return df.select(*df.columns, *[
        F.when(st[f"{c}__sd"] == 0, F.lit(0.0))
        .otherwise((F.col(c) - st[f"{c}__mu"]) / st[f"{c}__sd"]).alias(f"{c}{suffix}") for c in cols])


def one_hot(df: DataFrame, col: str, prefix: str | None = None) -> DataFrame:
    """A2: one 0/1 column per category seen at fit time (sorted); unknown/null -> zeros."""
    indexer = StringIndexer(inputCol=col, outputCol=f"{col}__idx", handleInvalid="keep",
                            stringOrderType="alphabetAsc").fit(df)
    enc = OneHotEncoder(inputCols=[f"{col}__idx"], outputCols=[f"{col}__ohe"], dropLast=True,
                        handleInvalid="keep").fit(indexer.transform(df))
    out = enc.transform(indexer.transform(df)).withColumn("__arr", vector_to_array(f"{col}__ohe"))
    p = prefix or col
    return out.select(*df.columns, *[F.col("__arr")[i].alias(f"{p}_{lab}") for i, lab in enumerate(indexer.labels)])


# ---------------------------------------------------------------- pipelines
@dataclass
class Candidate:
    name: str
    make: callable
    params: dict = field(default_factory=dict)


def random_forest(label: str, weight: str | None = "weight", num_trees: int = 200, max_depth: int | None = 10,
                  min_instances: int = 1, max_features: str | float | int = "sqrt", seed: int = 42,
                  min_split: int = 5) -> TreeClassifier:
    """A5: the reference's default forest.  A node needs ``min_split`` rows to be split and its children
    ``min_instances``; without a depth limit trees end at depth 30; classes are balanced unless ``weight`` is
    None; ``max_features`` is "sqrt", "log2", "all", a share or a number."""
    return TreeClassifier(labelCol=label, featuresCol=FEATURES, spec=trees.Forest(
        trees=num_trees, depth=max_depth, min_split=min_split, min_leaf=min_instances, features=max_features,
        balanced=bool(weight), seed=seed))


def boosted_trees(label: str, weight: str | None = "positive", max_iter: int = 200, max_depth: int | None = 6,
                  step: float = 0.1, l2: float = 1.0, seed: int = 42) -> TreeClassifier:
    """Second-order boosting, level by level; positives weigh negatives / positives."""
    return TreeClassifier(labelCol=label, featuresCol=FEATURES,
                          spec=trees.Boosting(rounds=max_iter, depth=max_depth, step=step, l2=l2, weights=weight, seed=seed))


def leaf_boosted_trees(label: str, weight: str | None = "balanced", max_iter: int = 200, max_depth: int | None = 6,
                       step: float = 0.1, leaves: int = 31, min_instances: int = 20, seed: int = 42) -> TreeClassifier:
    """Boosting that splits the leaf of largest gain first, with balanced classes."""
    return TreeClassifier(labelCol=label, featuresCol=FEATURES, spec=trees.leaf_wise(
        rounds=max_iter, depth=max_depth, step=step, leaves=leaves, min_leaf=min_instances, weights=weight, seed=seed))


def build_pipeline(numeric: Sequence[str], categorical: Sequence[str], classifier, impute=None) -> Pipeline:
    """A3: scale numerics (population std), one-hot categoricals (unknown -> zeros), assemble, classify.

    ``impute``, a stage such as ``prep_stages.ImputerStage``, comes first: its statistics are those of the rows that the
    pipeline is fitted on, and they are saved with it."""
    stages = [impute] if impute is not None else []
    parts = []
    if numeric:
        stages.append(PopulationScaler(inputCols=list(numeric), outputCol="__num_s"))
        parts.append("__num_s")
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                                 stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=[f"{c}__idx"], outputCols=[f"{c}__ohe"], dropLast=True,
                                 handleInvalid="keep")]
        parts.append(f"{c}__ohe")
    # missing numbers reach the trees, which have a branch for them
    stages += [VectorAssembler(inputCols=parts, outputCol=FEATURES, handleInvalid="keep"), classifier]
    return Pipeline(stages=stages)


def with_probability(pred: DataFrame) -> DataFrame:
    """Positive-class probability as a double column."""
    return pred.withColumn(PROB1, vector_to_array("probability")[1])


def train(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str],
          classifier=None, impute=None) -> PipelineModel:
    """Default forest with balanced class weights; ``impute`` as in ``build_pipeline``."""
    clf = classifier or random_forest(label)
    # trees weigh the classes themselves
    data = df.withColumn(KEY, row_hash(df)) if isinstance(clf, TreeClassifier) else with_weight_column(df, label)
    return build_pipeline(numeric, categorical, clf, impute).fit(data)


# ---------------------------------------------------------------- evaluation of models
class MacroF1Evaluator(Evaluator):
    """Macro F1 (the built-in evaluator only has weighted F1)."""

    def __init__(self, label: str, prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        m = per_group_metrics(dataset.withColumn("__g", F.lit(0)), "__g", self.label, self.prediction)
        return float(m.first()["f1_macro"])

    def isLargerBetter(self) -> bool:
        return True


_CV = ["f1_macro", "roc_auc", "precision_macro", "recall_macro"]


def tree_inputs(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """The feature columns of the pipeline as trees see them: numbers as they are, a 0/1 column for each category."""
    seen = df.select(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in categorical]).first() if categorical else ()
    return [F.col(c) for c in numeric] + [F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0)
                                          for c, values in zip(categorical, seen) for v in values]


def _cv_board(df: DataFrame, label: str, numeric, categorical, fold_col: str, classifiers: Sequence[TreeClassifier],
              with_train: bool) -> DataFrame:
    """A row of CV statistics for each classifier (``candidate``, from 0): all folds of all of them in the same jobs."""
    ship(df.sparkSession)
    rows = trees.prepare(df, tree_inputs(df, numeric, categorical), label, row_hash(df, fold_col), fold_col)
    k = (rows.agg(F.max("fold")).first()[0] or 0) + 1
    scored = trees.cross_scores(rows, [trees.Task(c.spec, f) for c in classifiers for f in range(k)], None, with_train)
    scored = materialize(scored.select("task", "unseen", F.col("y").cast("int").alias("label"), "probability",
                                       (F.col("probability") > 0.5).cast("double").alias("prediction")), "cv-scores")
    own, candidate = scored.where("unseen"), F.floor(F.col("task") / k).cast("int").alias("candidate")
    per = per_group_metrics(own, "task").join(roc_auc_by(own, ["task"], "label", "probability"), "task")
    out = per.groupBy(candidate).agg(*[a for m in _CV for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])
    if with_train:
        train_ = per_group_metrics(scored.where("not unseen"), "task").groupBy(candidate).agg(F.avg("f1_macro").alias("train_f1_macro_mean"))
        out = out.join(train_, "candidate")
    return out


def cross_validate(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str],
                   fold_col: str = "fold", classifier_factory=None, with_train: bool = True,
                   written: bool = False, impute=None) -> DataFrame:
    """Per-fold fit/predict; metrics from one table of fold predictions.

    Trees are fitted for all folds at once; another classifier, and any pipeline with an ``impute`` stage, whose
    statistics are those of each fold's training part (D7), fold by fold, and ``df``, which every pass of every
    fit reads, is written first then, unless the caller has (``written``).

    Returns one row: mean and population std of macro F1, AUC, macro precision and
    macro recall, plus the mean train macro F1.
    """
    first = classifier_factory() if classifier_factory else random_forest(label)
    if isinstance(first, TreeClassifier) and impute is None:
        return _cv_board(df, first.getLabelCol(), numeric, categorical, fold_col, [first], with_train).drop("candidate")
    data = df if written else materialize(df, "folds")
    k = data.select(F.max(fold_col)).first()[0] + 1
    preds, train_preds = [], []
    for f in range(k):
        tr, te = data.where(F.col(fold_col) != f), data.where(F.col(fold_col) == f)
        model = train(tr, label, numeric, categorical, classifier_factory() if classifier_factory else first, impute)
        preds.append(with_probability(model.transform(te)).select(fold_col, label, "prediction", PROB1))
        if with_train:
            train_preds.append(model.transform(tr).select(F.lit(f).alias(fold_col), label, "prediction"))
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    allp = materialize(allp)  # k model applications feed two aggregates and a sampling job
    per = per_group_metrics(allp, fold_col, label).join(roc_auc_by(allp, [fold_col], label, PROB1), fold_col)
    out = cv_summary(per, _CV)
    if with_train:
        tp = train_preds[0]
        for p in train_preds[1:]:
            tp = tp.unionByName(p)
        train_f1 = scalars(per_group_metrics(tp, fold_col, label).agg(F.avg("f1_macro").alias("t")))["t"]
        out = out.withColumn("train_f1_macro_mean", train_f1)
    return out


def compare_models(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str],
                   candidates: Sequence[Candidate], fold_col: str = "fold") -> DataFrame:
    """CV every candidate; a failing one is listed with its error and can't win; best by macro
    F1 with the first candidate winning ties.  Returns the leaderboard with ``selected``; an AUC
    that is not defined is null.  All tree candidates are fitted in the same jobs."""
    spark, df = df.sparkSession, materialize(df, "folds")
    rows, grown = {}, {}
    for i, c in enumerate(candidates):
        try:
            made = c.make()
            if isinstance(made, TreeClassifier):
                if made.getLabelCol() != label:
                    raise ValueError(f"the candidate's label is {made.getLabelCol()}, the comparison's {label}")
                grown[i] = made
            else:
                s = cross_validate(df, label, numeric, categorical, fold_col, c.make, with_train=False, written=True).first()
                rows[i] = (i, c.name, s["f1_macro_mean"], s["roc_auc_mean"], None)
        except (PySparkException, Py4JJavaError, ValueError) as e:  # the reference goes on without a failing candidate
            rows[i] = (i, c.name, None, None, f"{type(e).__name__}: {str(e)[:300]}")
    if grown:
        for s in _cv_board(df, label, numeric, categorical, fold_col, list(grown.values()), with_train=False).collect():
            i = list(grown)[s["candidate"]]
            rows[i] = (i, candidates[i].name, s["f1_macro_mean"], s["roc_auc_mean"], None)
    listed = [rows[i] for i in sorted(rows)]
    board = spark.createDataFrame(listed, "rank_in_list int, algorithm string, f1_macro_mean double, roc_auc_mean double, "
                                          "error string")
    best = max((r for r in listed if r[2] is not None), key=lambda r: (r[2], -r[0]), default=(-1,))[0]
    return board.withColumn("selected", F.col("rank_in_list") == best)


def param_grid_sample(grid: dict, n_iter: int = 10, seed: int = 42) -> list[dict]:
    """T4: seeded draw of n_iter distinct points of a small grid (driver-side, bounded)."""
    keys = list(grid)
    points = [{}]
    for k in keys:
        points = [dict(p, **{k: v}) for p in points for v in grid[k]]
    rng = random.Random(seed)
    return rng.sample(points, min(n_iter, len(points)))


def tune(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], grid: dict,
         n_iter: int = 10, fold_col: str = "fold", seed: int = 42) -> DataFrame:
    """A10: random search over the grid with k-fold macro F1; best point first."""
    return _search(df, label, numeric, categorical, grid, n_iter, fold_col, seed)[0]


def tune_and_fit(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], grid: dict,
                 n_iter: int = 10, fold_col: str = "fold", seed: int = 42) -> tuple[DataFrame, PipelineModel]:
    """A10 with the refit: (the board, the pipeline with the best point fitted on all rows)."""
    board, best = _search(df, label, numeric, categorical, grid, n_iter, fold_col, seed)
    return board, train(df, label, numeric, categorical, random_forest(label, **best))


def _search(df, label, numeric, categorical, grid, n_iter, fold_col, seed) -> tuple[DataFrame, dict]:
    points = param_grid_sample(grid, n_iter, seed)
    board = _cv_board(df, label, numeric, categorical, fold_col, [random_forest(label, **p) for p in points], with_train=False)
    rows = [(s["candidate"], str(sorted(points[s["candidate"]].items())), float(s["f1_macro_mean"])) for s in board.collect()]
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    board = df.sparkSession.createDataFrame(rows, "point int, params string, f1_macro_mean double")
    return board.orderBy(F.desc("f1_macro_mean"), "point"), points[best]


def slot_names(model: PipelineModel) -> list[str]:
    """Names of the assembled feature vector's slots, in order: the numeric inputs, then
    one ``<column>_<category>`` per one-hot slot (fitted labels, sorted)."""
    numeric, labels = [], {}
    for st in model.stages:
        if isinstance(st, PopulationScalerModel):
            numeric = list(st.getInputCols())
        if hasattr(st, "labels") and hasattr(st, "getInputCol"):
            labels[st.getInputCol()] = list(st.labels)
    final = [st for st in model.stages if isinstance(st, VectorAssembler)][-1]
    names = []
    for part in final.getInputCols():
        if part == "__num_s":
            names += numeric
        elif part.endswith("__ohe"):
            c = part[: -len("__ohe")]
            names += [f"{c}_{lab}" for lab in labels.get(c, [])]
    return names


def feature_importance(model: PipelineModel, spark_or_df, top_n: int = 20) -> DataFrame:
    """Importances named by vector slot, descending, top N (none for models without
    importances)."""
    spark = getattr(spark_or_df, "sparkSession", spark_or_df)
    clf = model.stages[-1]
    if not hasattr(clf, "featureImportances"):
        return spark.createDataFrame([], "feature string, importance double")
    names = slot_names(model)
    imp = clf.featureImportances.toArray()
    rows = [(names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top_n)
