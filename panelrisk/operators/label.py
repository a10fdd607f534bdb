"""Label encoding and class weights (A4).

The whole-column "is it binary?" decision (L3) is a one-row aggregate, written once and used as a
scalar subquery; the choice is a CASE per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.functions.columns import lenient_double, rule_flag, scalars, text_code
from panelrisk.session import materialize


def encode_label(df: DataFrame, label: str, rule: Sequence[tuple[str, float]],
                 text_map: Mapping[str, int]) -> DataFrame:
    """Make ``label`` an int 0/1 column.

    absent -> rule; text -> map (unknown -> rule); all present values in {0, 1} ->
    keep, null -> rule; otherwise signed: < 0 -> 1, >= 0 -> 0, null -> rule.
    """
    derived = rule_flag(rule)
    if label not in df.columns:
        return df.withColumn(label, derived.cast("int"))
    dt = df.schema[label].dataType
    x = text_code(F.col(label), text_map).cast("double") if isinstance(dt, T.StringType) \
        else lenient_double(F.col(label))
    staged = df.withColumn("__y", x)
    # mapped text is 0, 1 or null by construction: nothing to look for in the data
    binary = F.lit(True) if isinstance(dt, T.StringType) else scalars(materialize(staged.agg(F.coalesce(
        F.bool_and(F.when(F.col("__y").isNotNull(), F.col("__y").isin(0.0, 1.0))), F.lit(True)).alias("b")), "binary"))["b"]
    signed = F.when(F.col("__y") < 0, 1).when(F.col("__y").isNotNull(), 0)
    value = F.when(binary, F.coalesce(F.col("__y").cast("int"), derived)) \
        .otherwise(F.coalesce(signed, derived))
    return staged.select(*[value.cast("int").alias(c) if c == label else F.col(c) for c in df.columns])


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """A4: balanced weight n / (k * n_class) per class, and n_neg / max(n_pos, 1).

    The per-class table has one row per class, so the global window over it is tiny.
    """
    dist = label_distribution(df, label)
    w = Window.partitionBy()
    n = F.sum("n").over(w)
    k = F.count(F.lit(1)).over(w)
    neg = F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).over(w)
    pos = F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).over(w)
    return dist.select(label, "n", (n / (k * F.col("n"))).alias("weight"),
                       (neg / F.greatest(pos, F.lit(1))).alias("imbalance_ratio"))


def with_weight_column(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach the balanced class weight to every row (join on a one-row-per-class table)."""
    cw = class_weights(df, label).select(F.col(label).alias("__cls"), F.col("weight").alias(name))
    # one row per class: a bounded broadcast
    return df.join(F.broadcast(cw), F.col(label) == F.col("__cls"), "left").drop("__cls")
