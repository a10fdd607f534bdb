"""Column-expression helpers: all built-in Catalyst expressions, no Python UDFs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.spec import DECISION_AT, TIER_LOW_BELOW, TIER_MEDIUM_UPTO


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN and NULL are one 'missing' in the reference; Spark keeps them apart."""
    x = col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def lenient_double(c: str | Column) -> Column:
    """P5: unparsable -> null (ANSI casts would raise)."""
    return _try_cast(col(c), "double")


def _try_cast(c: Column, to: str) -> Column:
    return c.try_cast(to)


def leading_int(c: str | Column) -> Column:
    """P6: '7G' -> 7.0, '8' -> 8.0, 'X' / null -> null."""
    return _try_cast(F.regexp_extract(col(c).cast("string"), r"^(\d+)", 1), "double")


def text_code(c: str | Column, mapping: Mapping[str, int]) -> Column:
    """Lower-case (no trim) lookup; unknown -> null."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[F.lower(col(c))]


def row_mean(cols: Sequence[str | Column]) -> Column:
    """mean over the non-null members; all null -> null."""
    total = sum((F.coalesce(col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    present = sum((F.when(col(c).isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return total / F.nullif(present, F.lit(0))


def non_null_count(cols: Sequence[str | Column]) -> Column:
    return sum((F.when(col(c).isNotNull() & ~_is_nan(col(c)), 1).otherwise(0) for c in cols), F.lit(0))


def _is_nan(c: Column) -> Column:
    # isnan on non-float types is false; keep expression type-safe
    return F.coalesce(F.isnan(c.try_cast("double")), F.lit(False))


def rule_flag(rule: Sequence[tuple[str, float]]) -> Column:
    """L1: 1 if any column is strictly below its threshold; null comparisons count false."""
    cond = F.lit(False)
    for c, thr in rule:
        cond = cond | F.coalesce(col(c) < F.lit(thr), F.lit(False))
    return F.when(cond, 1).otherwise(0)


def risk_tier(p: str | Column) -> Column:
    """P < 0.40 baixo; p <= 0.70 medio; else alto (on the unrounded p)."""
    x = col(p)
    return (F.when(x < F.lit(TIER_LOW_BELOW), "baixo")
            .when(x <= F.lit(TIER_MEDIUM_UPTO), "medio")
            .when(x.isNotNull(), "alto"))


def decision(p: str | Column) -> Column:
    """P >= 0.5."""
    return col(p) >= F.lit(DECISION_AT)


def half_up(c: str | Column, digits: int) -> Column:
    """C4: Python-style round of the displayed value (HALF_UP on the decimal)."""
    return F.round(col(c), digits)


def safe_div(num: Column, den: Column) -> Column:
    """x / y, zero-division -> 0 (sklearn zero_division=0)."""
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType))


def scalars(one_row: DataFrame) -> dict[str, Column]:
    """The columns of a one-row aggregate as values - no join.  All of them are fields of
    one struct-valued scalar subquery, so the aggregate runs once per query however many
    fields are used."""
    one = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias("_s")).scalar()
    return {c: one.getField(c) for c in one_row.columns}
