"""Missing-data operators.

All statistics are aggregates used lazily: group medians are a distributed table
(one row per group, joined with a plain equi-join that AQE turns into a broadcast only
when its measured size allows); global medians and modes are one-row aggregates used
as scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.functions.columns import scalars
from panelrisk.operators.stats import CNT, VAL, VAR, long_values, medians_wide, modes_row, radix_medians, widen_medians
from panelrisk.session import materialize


def _missing(c: str, dt: T.DataType):
    x = F.col(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def drop_sparse_rows(df: DataFrame) -> DataFrame:
    """M1: keep a row iff more than half of ALL its columns are present (NaN = missing)."""
    n = len(df.columns)
    return df.na.drop(thresh=int(n * 0.5) + 1)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, prefix: str = "n_null_") -> DataFrame:
    """M6: one row, the count of missing values per column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols or df.columns)
    return df.agg(*[F.count_if(_missing(c, types[c])).alias(f"{prefix}{c}") for c in cols])


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Ingest rule: NaN -> NULL in float columns, so median/avg skip it."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (cols or df.columns) if isinstance(types[c], (T.FloatType, T.DoubleType))]
    if not cols:
        return df
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None).cast(types[c])).otherwise(F.col(c)) for c in cols})


def group_median_tables(df: DataFrame, cols: Sequence[str], group: str, null_group: str = "keep",
                        few: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Fit M2 + M3 by radix selection, without a shuffle or a copy of the values.

    The missing values are counted per group and column.  The column after the group fill is, as a multiset, its
    present values plus each group's missing count at that group's median, so the fallback median selects
    from the source and that small table instead of the filled frame.

    Returns (per-group ``{c}__g`` table, one-row fallback ``{c}__a``, one-row overwrite
    flags ``{c}__hn`` or None).
    """
    values = long_values(df, cols, [group])
    gmed = widen_medians(radix_medians(values.where(F.col(group).isNotNull()), [group], few), cols, [group], "__g")
    gone = lambda c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c)
    nulls = materialize(df.groupBy(group).agg(*[gone(c) for c in cols]), "null-counts")
    hn_row, kept = None, values
    if null_group == "overwrite":
        hn_row = nulls.agg(*[(F.sum(c) > 0).cast("int").alias(f"{c}__hn") for c in cols])
        found = hn_row.first()
        emptied = [c for c in cols if found[f"{c}__hn"]]
        if emptied:
            kept = values.where(F.col(group).isNotNull() | ~F.col(VAR).isin(emptied))
    at = gmed.select(group, *[F.col(f"{c}__g").alias(c) for c in cols]).unpivot([group], cols, VAR, VAL).where(F.col(VAL).isNotNull())
    fill = nulls.unpivot([group], cols, VAR, CNT).where(F.col(CNT) > 0).join(at, [group, VAR]).select(VAR, VAL, CNT)
    gall_row = widen_medians(radix_medians(kept.select(VAR, VAL, CNT).unionByName(fill), [], few), cols, suffix="__a")
    return gmed, gall_row, hn_row


def impute_group_median(df: DataFrame, cols: Sequence[str], group: str,
                        null_group: str = "keep", few: int | None = None) -> DataFrame:
    """M2 + M3: null -> median of its group; what is still null -> global median of the
    column *after* the group fill (statistics from ``group_median_tables``, one pass).

    ``null_group="keep"`` leaves values of rows with a null group key alone;
    ``"overwrite"`` reproduces the reference, which replaces every value of such rows
    (in a column that has at least one null) with the global fallback.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    others = [c for c in df.columns]
    gmed, gall_row, hn_row = group_median_tables(df, cols, group, null_group, few)
    if hn_row is not None:
        hn = scalars(hn_row)
        filled = {c: F.when(F.col(group).isNull() & (hn[f"{c}__hn"] == 1), F.lit(None).cast("double"))
                  .otherwise(F.coalesce(F.col(c).cast("double"), F.col(f"{c}__g"))) for c in cols}
    else:
        filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}__g")) for c in cols}
    step1 = df.join(gmed.withColumnRenamed(group, "__grp"), F.col(group) == F.col("__grp"), "left")
    step1 = step1.select(*[filled.get(c, F.col(c)).alias(c) for c in others])
    gall = scalars(gall_row)
    return step1.select(*[F.coalesce(F.col(c), gall[f"{c}__a"]).alias(c) if c in cols else F.col(c)
                          for c in others])


def impute_global_median(df: DataFrame, cols: Sequence[str], few: int | None = None) -> DataFrame:
    """M4: null -> global median (no group column)."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    gall = scalars(medians_wide(df, cols, suffix="__a", few=few))
    return df.select(*[F.coalesce(F.col(c).cast("double"), gall[f"{c}__a"]).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def impute_mode(df: DataFrame, cols: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """M5: null -> most frequent value (ties: smallest); an all-null column stays null.

    ``source``: a frame with the same rows and the same values in ``cols`` to count the
    modes on (e.g. the input of a median fill that does not touch ``cols``)."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    # one row, written: every later read of the result would count the modes again
    modes = scalars(materialize(modes_row(df if source is None else source, cols, "__mode"), "modes"))
    return df.select(*[F.coalesce(F.col(c), modes[f"{c}__mode"]).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def handle_missing_values(df: DataFrame, indicators: Sequence[str], group: str | None,
                          categoricals: Sequence[str], null_group: str = "keep",
                          cut_lineage: bool = False) -> DataFrame:
    """M7: sparse-row filter -> group (or global) median -> mode.

    The statistics read the input some times (see ``stats``); with
    ``cut_lineage`` the filtered input and the median-filled frame are also written
    once, for inputs that are expensive to recompute.
    """
    from panelrisk.session import materialize
    keep = materialize if cut_lineage else (lambda x: x)
    base = keep(drop_sparse_rows(nan_to_null(df)))
    num = [c for c in indicators if c in base.columns]
    cats = [c for c in categoricals if c in base.columns]
    out = base
    if group and group in out.columns and num:
        out = impute_group_median(out, num, group, null_group)
    elif num:
        out = impute_global_median(out, num)
    # the median fill keeps the rows and leaves other columns alone: when no categorical
    # is median-filled, count the modes on its input (a plain scan, no join)
    return impute_mode(keep(out), cats, None if set(cats) & set(num) else base)


class PanelImputer:
    """Estimator: fits group medians, global fallbacks and modes once; the model
    applies the stored tables to any frame (the reference refits on every frame)."""

    def __init__(self, indicators: Sequence[str], group: str | None, categoricals: Sequence[str]):
        self.indicators, self.group, self.categoricals = list(indicators), group, list(categoricals)

    def fit(self, df: DataFrame) -> "PanelImputerModel":
        """One pass for the median tables and one for all the modes."""
        num = [c for c in self.indicators if c in df.columns]
        group_tab, global_tab = None, None
        if self.group and self.group in df.columns and num:
            group_tab, global_tab, _ = group_median_tables(df, num, self.group)
        elif num:
            global_tab = medians_wide(df, num, suffix="__a")
        cats = [c for c in self.categoricals if c in df.columns]
        mode_row = modes_row(df, cats, "__mode") if cats else None
        return PanelImputerModel(num, self.group, cats, group_tab, global_tab, mode_row)


class PanelImputerModel:
    _TABLES = ("group_tab", "global_tab", "mode_row")
    _ABOUT = "num array<string>, `group` string, cats array<string>, tables array<string>"

    def __init__(self, num, group, cats, group_tab, global_tab, mode_row):
        self.num, self.group, self.cats = num, group, cats
        self.group_tab, self.global_tab, self.mode_row = group_tab, global_tab, mode_row

    def save(self, path: str) -> None:
        """Writes the fitted tables and what they are for under ``path``."""
        spark = SparkSession.active()
        for name in self._TABLES:
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        kept = [n for n in self._TABLES if getattr(self, n) is not None]
        spark.createDataFrame([(self.num, self.group, self.cats, kept)], self._ABOUT).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark, path: str) -> "PanelImputerModel":
        about = spark.read.schema(cls._ABOUT).parquet(f"{path}/about").first()
        tables = [spark.read.parquet(f"{path}/{n}") if n in about.tables else None for n in cls._TABLES]
        return cls(list(about.num), about.group, list(about.cats), *tables)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        fills = {}
        if self.group_tab is not None:
            g = self.group_tab.withColumnRenamed(self.group, "__grp")
            out = out.join(g, F.col(self.group) == F.col("__grp"), "left")
            for c in self.num:
                fills[c] = [F.col(f"{c}__g")]
        if self.global_tab is not None:
            g_all = scalars(self.global_tab)
            for c in self.num:
                fills.setdefault(c, []).append(g_all[f"{c}__a"])
        if self.mode_row is not None:
            modes = scalars(self.mode_row)
            for c in self.cats:
                fills.setdefault(c, []).append(modes[f"{c}__mode"])
        return out.select(*[F.coalesce(F.col(c), *fills[c]).alias(c) if c in fills else F.col(c)
                            for c in df.columns])
