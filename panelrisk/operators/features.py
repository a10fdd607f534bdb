"""Feature operators F1-F7: composites, gap, below-median flag, lag diff, interactions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.columns import row_mean, scalars
from panelrisk.operators.ordered import plain_lag, segmented_lag
from panelrisk.operators.stats import medians_wide
from panelrisk.session import materialize
from panelrisk.spec import PanelSpec


def add_row_means(df: DataFrame, composites: Mapping[str, Sequence[str]]) -> DataFrame:
    """one null-skipping row mean per composite, over the members present in df."""
    out = df
    for name, members in composites.items():
        present = [c for c in members if c in df.columns]
        if present:
            out = out.withColumn(name, row_mean(present))
    return out


def add_gap(df: DataFrame, minuend: str, subtrahend: str, name: str) -> DataFrame:
    """minuend - subtrahend, when both columns exist."""
    if minuend in df.columns and subtrahend in df.columns:
        return df.withColumn(name, F.col(minuend) - F.col(subtrahend))
    return df


def add_all_below_median(df: DataFrame, cols: Sequence[str], name: str,
                         few: int | None = None) -> DataFrame:
    """1 iff every present column is strictly below its column median; null -> 0.

    The medians are one row, used as scalar subqueries.
    """
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    med = scalars(medians_wide(df, present, suffix="__med", few=few))
    cond = F.lit(True)
    for c in present:
        cond = cond & F.coalesce(F.col(c) < med[f"{c}__med"], F.lit(False))
    return df.withColumn(name, F.when(cond, 1).otherwise(0))


def add_lag_diff(df: DataFrame, value: str, entity: str | None, period: str, name: str,
                 tie: Sequence[str | Column] = (), skew_safe: bool = True,
                 n_buckets: int | None = None) -> DataFrame:
    """value minus the previous row's value of the same entity, ordered by period.

    First row of an entity, a null on either side, a null entity -> 0.  No entity, period or
    value column -> constant 0.0.  ``tie`` orders rows sharing (entity, period); without it
    the value itself breaks ties so the result is deterministic.
    """
    if entity is None or not {entity, period, value} <= set(df.columns):
        return df.withColumn(name, F.lit(0.0))
    if skew_safe:
        # rows without an entity have no history: they are answered outside the scan, where they
        # would all meet in one segment
        df = materialize(df, "lag-input")
        loose = df.where(F.col(entity).isNull()).withColumn(name, F.lit(0.0))
        df = df.where(F.col(entity).isNotNull())
    order = [F.col(period), *[F.col(t) if isinstance(t, str) else t for t in tie]]
    if not tie:
        order.append(F.col(value))
    if skew_safe:
        lagged = segmented_lag(df, [entity], order, {"__prev": value}, n_buckets, written=True)
        diff = F.coalesce(F.col(value) - F.col("__prev"), F.lit(0.0)).cast("double")
        return lagged.withColumn(name, diff).drop("__prev").unionByName(loose)
    lagged = plain_lag(df, [entity], order, {"__prev": value})
    diff = F.coalesce(F.col(value) - F.col("__prev"), F.lit(0.0))
    return (lagged.withColumn(name, F.when(F.col(entity).isNull(), F.lit(0.0)).otherwise(diff).cast("double"))
            .drop("__prev"))


def sort_panel(df: DataFrame, entity: str | None, period: str) -> DataFrame:
    """F8: rows ordered by (entity, period), nulls first: a range shuffle, for ordered output only."""
    return df.orderBy(*[c for c in (entity, period) if c and c in df.columns])


def add_interactions(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """products a*b for each (a, b, name) whose inputs both exist."""
    out = df
    for a, b, name in pairs:
        if a in out.columns and b in out.columns:
            out = out.withColumn(name, F.col(a) * F.col(b))
    return out


def composite_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    out = add_row_means(df, spec.composites)
    if spec.gap:
        out = add_gap(out, spec.gap[0], spec.gap[1], spec.gap_name)
    if spec.below_median:
        out = add_all_below_median(out, spec.below_median, spec.below_name)
    return out


def transform_features(df: DataFrame, spec: PanelSpec, tie: Sequence[str] = (),
                       skew_safe: bool = True) -> DataFrame:
    """composites -> temporal -> interactions (the reference's order).

    Composites are narrow expressions plus a one-row median table, so the lag's
    sample and scan re-derive them cheaply from the (materialized) prepared panel.
    """
    out = composite_features(df, spec)
    out = add_lag_diff(out, spec.anchor, spec.entity_in(out.columns), spec.period, spec.lag_name,
                       tie=tie, skew_safe=skew_safe)
    pairs = [(spec.anchor, spec.group, spec.anchor_x_group)]
    if spec.composite_product:
        pairs.append(spec.composite_product)
    return add_interactions(out, pairs)


def select_features(df: DataFrame, base: Sequence[str], engineered: Sequence[str],
                    excluded: Sequence[str]) -> list[str]:
    """Ordered base + engineered candidates present, minus excluded, numeric only."""
    from panelrisk.functions.columns import is_numeric_type
    types = {f.name: f.dataType for f in df.schema.fields}
    cands = [c for c in [*base, *engineered] if c in types]
    return [c for c in cands if c not in set(excluded) and is_numeric_type(types[c])]
