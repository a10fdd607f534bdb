"""Evaluation as distributed aggregates over (label, prediction, score).

Everything is a ``groupBy`` with map-side combine down to per-class or per-score
counts; the ordered parts (AUC, ROC) run on distinct scores with the bucketed scan,
never a single-partition window over the predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.columns import safe_div, scalars
from panelrisk.operators.ordered import range_bucket, running_sums
from panelrisk.session import materialize
from panelrisk.spec import GATES


def pair_counts(df: DataFrame, label: str = "label", pred: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, pred, n), written once: the only read of the predictions.  It has at most
    classes squared rows (for each value of ``by``), and E1 to E4 are aggregates of it."""
    return materialize(df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred"))
                       .agg(F.count(F.lit(1)).alias("n")), "pair-counts")


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Dense (actual, predicted, n) over the sorted classes, zeros included."""
    counts = pair_counts(df, label, pred)
    cls = (counts.select(F.explode(F.array("label", "pred")).alias("cls")).where("cls is not null")
           .agg(F.array_sort(F.collect_set("cls")).alias("c")))
    grid = cls.select(F.explode("c").alias("actual"), "c").select("actual", F.explode("c").alias("predicted"))
    return (grid.join(counts.toDF("actual", "predicted", "n"), ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def _report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support by class (and ``by``), from the pair counts."""
    n = F.col("n")
    sides = (counts.select(*by, F.explode(F.array(
        F.struct(F.col("label").alias("cls"), n.alias("support"), F.when(F.col("label") == F.col("pred"), n)
                 .otherwise(0).alias("tp"), F.lit(0).cast("long").alias("n_pred")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"),
                 n.alias("n_pred")))).alias("s")).select(*by, "s.*").where("cls is not null"))
    c = sides.groupBy(*by, "cls").agg(*[F.sum(x).alias(x) for x in ("support", "tp", "n_pred")])
    tp = F.col("tp").cast("double")
    return (c.select(*by, "cls", safe_div(tp, F.col("n_pred").cast("double")).alias("precision"),
                     safe_div(tp, F.col("support").cast("double")).alias("recall"), F.col("support").cast("long").alias("support"))
            .withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"),
                                       F.col("precision") + F.col("recall"))))


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; zero division -> 0."""
    return _report(pair_counts(df, label, pred))


def summary_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                    positive: int = 1) -> DataFrame:
    """E3 + E4: one row - macro/weighted F1, macro precision/recall, accuracy, positive recall."""
    return _summary(pair_counts(df, label, pred), positive)


def _summary(counts: DataFrame, positive: int = 1) -> DataFrame:
    acc = counts.agg(safe_div(F.coalesce(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))), F.lit(0)).cast("double"),
                              F.sum("n").cast("double")).alias("accuracy"))
    m = _report(counts).agg(
        F.avg("f1").alias("f1_macro"),
        safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.coalesce(F.max(F.when(F.col("cls") == positive, F.col("recall"))), F.lit(0.0)).alias("recall_positiva"))
    return m.withColumn("accuracy", scalars(acc)["accuracy"])


def score_counts(df: DataFrame, label: str = "label", score: str = "score", positive: int = 1) -> DataFrame:
    """(score, pos, neg) per distinct score - the map-side combine collapses hot scores."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == positive).alias("pos"),
        F.count_if(F.col(label) != positive).alias("neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive: int = 1,
            n_buckets: int | None = None) -> DataFrame:
    """E5: exact ROC-AUC (Mann-Whitney, ties count one half).  One class -> null."""
    return roc_auc_by(df, [], label, score, positive, n_buckets)


def roc_auc_by(df: DataFrame, group: Sequence[str], label: str = "label", score: str = "score",
               positive: int = 1, n_buckets: int | None = None) -> DataFrame:
    """E5 per group (e.g. per CV fold) in one pass: one row per group."""
    counts = materialize(df.groupBy(*group, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == positive).alias("pos"),
        F.count_if(F.col(label) != positive).alias("neg")))
    return _auc(counts, list(group), n_buckets)


def _auc(counts: DataFrame, g: list[str], n_buckets: int | None = None) -> DataFrame:
    cum = running_sums(range_bucket(counts, ["score"], n_buckets), g, ["score"],
                       {"neg_below": F.col("neg")}, exclusive=True)
    return cum.groupBy(*g).agg((F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5))
                                / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("roc_auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", positive: int = 1,
              n_buckets: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, thresholds descending."""
    g = materialize(score_counts(df, label, score, positive).withColumn("_neg_score", -F.col("score")))
    cum = running_sums(range_bucket(g, ["_neg_score"], n_buckets), [], ["_neg_score"],
                       {"tps": F.col("pos"), "fps": F.col("neg")})
    tot = scalars(g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    return cum.select(
        F.col("score").alias("threshold"),
        (F.col("fps") / F.nullif(tot["N"], F.lit(0))).alias("fpr"),
        (F.col("tps") / F.nullif(tot["P"], F.lit(0))).alias("tpr"))


def evaluate(df: DataFrame, label: str = "label", pred: str = "prediction", score: str = "score",
             positive: int = 1) -> DataFrame:
    """O2: the reference's metric set as one row, from one read of the predictions."""
    base = materialize(df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred"), F.col(score).alias("score"))
                       .agg(F.count(F.lit(1)).alias("n")), "scored-counts")
    pairs = materialize(base.groupBy("label", "pred").agg(F.sum("n").alias("n")), "pair-counts")
    n = F.col("n")
    scores = materialize(base.groupBy("score").agg(
        F.coalesce(F.sum(F.when(F.col("label") == positive, n)), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(F.col("label") != positive, n)), F.lit(0)).alias("neg")), "score-counts")
    return _summary(pairs, positive).withColumn("roc_auc", scalars(_auc(scores, []))["roc_auc"])


def metrics_long(metrics_row: DataFrame) -> DataFrame:
    """One-row metric frame -> (metric, value)."""
    cols = metrics_row.columns
    return metrics_row.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("double") for c in cols]))
    ).alias("metric", "value"))


def release_gates(metrics: DataFrame, gates: Sequence[tuple[str, float]] = GATES) -> DataFrame:
    """Per gate (metric >= threshold, inclusive; missing metric counts 0) + overall."""
    spark = metrics.sparkSession
    g = spark.createDataFrame([(m, float(t)) for m, t in gates], "metric string, threshold double")
    j = g.join(metrics_long(metrics), "metric", "left")
    per = j.select("metric", F.coalesce("value", F.lit(0.0)).alias("value"), "threshold") \
        .withColumn("passed", F.col("value") >= F.col("threshold"))
    overall = per.agg(F.lit("all").alias("metric"), F.lit(None).cast("double").alias("value"),
                      F.lit(None).cast("double").alias("threshold"), F.bool_and("passed").alias("passed"))
    return per.unionByName(overall)


def confusion_as_matrix(cm: DataFrame) -> DataFrame:
    """Nested list form of E1 (rows = actual, sorted) - the reference's 2x2 list."""
    rows = cm.groupBy("actual").agg(F.array_sort(F.collect_list(F.struct("predicted", "n"))).alias("r"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("actual", F.col("r.n").alias("ns")))).alias("m")) \
        .select(F.col("m.ns").alias("confusion_matrix"))


def cv_summary(per_fold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A9 aggregate: mean and population std of each metric across folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_fold.agg(*aggs)


def per_group_metrics(df: DataFrame, group: str, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Macro F1 / precision / recall per group (fold) from one table of counts."""
    return (_report(pair_counts(df, label, pred, [group]), [group]).groupBy(group)
            .agg(F.avg("f1").alias("f1_macro"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro")))
