"""Schema, projection and reshape operators.

Name handling is plan-building Python over ``df.columns``; no job runs.  The
wide->long reshape is one scan: each input row explodes into one struct per kept
period, so no self-union and no per-period re-read of the wide table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.functions.columns import leading_int, lenient_double
from panelrisk.spec import EDUCATION_INDICATORS, EDUCATION_WIDE_OPTIONAL

def normalize_name(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().upper())


def normalize_column_names(df: DataFrame) -> DataFrame:
    """Trim -> upper -> whitespace runs to '_'.  Colliding results raise."""
    new = [normalize_name(c) for c in df.columns]
    dup = sorted({c for c in new if new.count(c) > 1})
    if dup:
        raise ValueError(f"column names collide after normalisation: {dup}")
    return df.toDF(*new)


def validate_schema(df: DataFrame, required: Iterable[str]) -> bool:
    """Every required name present (compared upper-cased); else ValueError."""
    absent = sorted(set(required).difference(map(str.upper, df.columns)))
    if absent:
        raise ValueError(f"required columns not found: {absent}")
    return True


@dataclass(frozen=True)
class YearlyColumn:
    """A column called ``<stem>_<period>``, the period being its last four digits."""

    name: str
    stem: str
    period: int

    @classmethod
    def parse(cls, name: str) -> YearlyColumn | None:
        stem, _, tail = name.rpartition("_")
        yearly = len(tail) == 4 and tail.isdecimal() and tail.isascii() and len(stem) < len(name) - 4
        return cls(name, stem, int(tail)) if yearly else None


def yearly_columns(columns: Iterable[str]) -> dict[int, dict[str, YearlyColumn]]:
    """The wide columns, by period (ascending) and stem; every name is parsed once."""
    found: dict[int, dict[str, YearlyColumn]] = {}
    for c in filter(None, map(YearlyColumn.parse, columns)):
        found.setdefault(c.period, {})[c.stem] = c
    return dict(sorted(found.items()))


def is_wide(columns: Iterable[str]) -> bool:
    """Any column named like NAME_YYYY."""
    return bool(yearly_columns(columns))


def discover_periods(columns: Iterable[str]) -> list[int]:
    """Sorted distinct 4-digit suffixes."""
    return list(yearly_columns(columns))


@dataclass(frozen=True)
class Target:
    """A long column: the stems that can fill it, in order of preference, and how each is read.

    ``how`` is "double" (lenient), "leading_int" or "as_is".
    """

    name: str
    sources: tuple[tuple[str, str], ...]

    def pick(self, present: Mapping[str, YearlyColumn]) -> tuple[YearlyColumn, str] | None:
        return next(((present[stem], how) for stem, how in self.sources if stem in present), None)


@dataclass(frozen=True)
class WideLayout:
    """How period-suffixed columns map to long columns."""

    indicators: tuple[str, ...]
    anchor: str
    entity: str | None = "NOME"
    period: str = "ANO"
    # group column: first present of (prefix, how); how = "value" | "leading_int"
    group: str = "FASE"
    group_sources: tuple[tuple[str, str], ...] = (("FASE", "value"), ("FASE_TURMA", "leading_int"))
    # optional text / label columns: long name -> candidate prefixes (first present wins)
    optional: tuple[tuple[str, tuple[str, ...]], ...] = EDUCATION_WIDE_OPTIONAL

    @property
    def targets(self) -> tuple[Target, ...]:
        group = tuple((stem, "leading_int" if how == "leading_int" else "double") for stem, how in self.group_sources)
        return (*(Target(i, ((i, "double"),)) for i in self.indicators), Target(self.group, group),
                *(Target(n, tuple((stem, "as_is") for stem in stems)) for n, stems in self.optional))


EDUCATION_LAYOUT = WideLayout(indicators=EDUCATION_INDICATORS, anchor="INDE")


_READ = {"double": lenient_double, "leading_int": leading_int, "as_is": lambda c: c}


def wide_to_long(df: DataFrame, layout: WideLayout = EDUCATION_LAYOUT) -> DataFrame:
    """One row per (input row, kept period); a period without its anchor is skipped.

    Indicators and the group are coerced leniently to double; columns not described by the
    layout are dropped.  No period kept -> the input is returned.
    """
    by_period = {p: c for p, c in yearly_columns(df.columns).items() if layout.anchor in c}
    if not by_period:
        return df
    picks = {p: {t.name: t.pick(c) for t in layout.targets} for p, c in by_period.items()}
    kinds = {t.name: _long_type(df, [picks[p][t.name] for p in picks]) for t in layout.targets}
    # columns in the order in which the periods, oldest first, bring them in
    names = list(dict.fromkeys(n for own in picks.values() for n, found in own.items() if found))

    def cell(name: str, found: tuple[YearlyColumn, str] | None) -> Column:
        value = F.lit(None) if found is None else _READ[found[1]](F.col(found[0].name))
        return value.cast(kinds[name]).alias(name)

    rows = [F.struct(F.lit(p).cast("int").alias(layout.period), *[cell(n, own[n]) for n in names])
            for p, own in picks.items()]
    keep = [layout.entity] if layout.entity in df.columns else []
    return df.select(*keep, F.inline(F.array(*rows)))


def _long_type(df: DataFrame, found: Sequence[tuple[YearlyColumn, str] | None]) -> T.DataType:
    """Double where all the source columns are numbers or read as such, else text."""
    present = [f for f in found if f]
    numeric = all(how != "as_is" or isinstance(df.schema[c.name].dataType, (T.NumericType, T.BooleanType))
                  for c, how in present)
    return T.DoubleType() if present and numeric else T.StringType()


def concat_panels(frames: Sequence[DataFrame]) -> DataFrame:
    """R2: UNION ALL by name; a column missing from a frame is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Whole-row distinct (nulls equal).  A map-side partial aggregate collapses hot
    duplicate rows before the shuffle."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def filter_features(columns: Iterable[str], numerical: Sequence[str],
                    categorical: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """Candidate lists intersected with what is present, order kept."""
    cols = set(columns)
    num = [c for c in numerical if c in cols]
    cat = [c for c in categorical if c in cols]
    return num, cat, num + cat


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """P10: all numeric (and boolean) columns except ``exclude``."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in ex]


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null (or NaN) in ``cols``."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def project_known(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Project to ``names`` in order, silently skipping unknown ones."""
    cols = set(df.columns)
    return df.select(*[n for n in names if n in cols])
