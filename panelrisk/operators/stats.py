"""Exact order statistics without one buffer per group.

``F.median`` / ``F.mode`` keep every distinct value of a group in one aggregation
buffer; a group holding a third of the data would sit in one task's memory.  Here:

* median - radix selection.  A value's 64 bits become a whole number of the same order.  One aggregate counts rows
  by their leading bits per (group, column); the bucket that holds the middle position is kept and counted
  by its next bits, until the value is known: at most five passes over the source, two where the kept buckets
  hold few rows.  Each pass shuffles one row per bucket that occurs (8,192 at most for a group
  and column, after map-side combining), never the values.  Exact (mean of the two middle values for even n).
* mode - (column value -> count) by ``groupBy`` then a one-row ``min_by`` on
  (-count, value): highest count, smallest value on ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.session import materialize

VAR, VAL, CNT = "_var", "_val", "_cnt"
#: Bits left unread after each pass: sign and exponent first, then 13 bits of the fraction a pass.
SHIFTS = (52, 39, 26, 13, 0)
#: Rows in the kept buckets, of all groups and columns, from which the rest is read in one pass.
FEW = 1_000_000
#: Kept buckets (two a group and column) that may pass through the driver; more are written.
LOCAL = 4_000


def long_values(df: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group..., _var, _val, _cnt): the present values of ``cols``, each counting once.  Narrow: nothing is shuffled."""
    g = list(group)
    return (df.select(*g, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(g, list(cols), VAR, VAL)
            .where(F.col(VAL).isNotNull() & ~F.isnan(VAL)).withColumn(CNT, F.lit(1).cast("long")))


_FRACTION = 1 << 52
_HALF_WAY = 2.0 ** 537  # its square times the smallest double is 1


def with_code(df: DataFrame, value: str = VAL, name: str = "_code") -> DataFrame:
    """``df`` with a column for the whole number that a double's bits spell, negative for negative ones: ordered like the doubles.

    All steps are exact: a power of two, and the quotient by it.  -0.0 counts as 0.0.  The steps are columns of their
    own, so that each is computed once a row.
    """
    size_, near_, part_, abs_ = (f"{name}_{c}" for c in ("size", "near", "part", "abs"))
    plain = df.withColumn(abs_, F.abs(F.col(value)))
    # may be one off, for the logarithm is rounded
    near = plain.withColumn(near_, F.least(F.floor(F.log2(F.when(F.col(abs_) > 0, F.col(abs_)))), F.lit(1023)))
    part = near.withColumn(part_, F.col(abs_) / F.pow(F.lit(2.0), F.col(near_).cast("double")))
    off = F.when(F.col(part_) < 1, -1).when(F.col(part_) >= 2, 1).otherwise(0)
    one = F.when(F.col(part_) < 1, F.col(part_) * 2).when(F.col(part_) >= 2, F.col(part_) / 2).otherwise(F.col(part_))
    size = (F.when(F.col(abs_) == float("inf"), F.lit(2047 * _FRACTION))
            .when(F.col(abs_) < 2.0 ** -1022, (F.col(abs_) * _HALF_WAY * _HALF_WAY).cast("long"))
            .otherwise((F.col(near_) + off + 1023) * _FRACTION + ((one - 1) * float(_FRACTION)).cast("long")))
    sized = part.withColumn(size_, size)
    return sized.withColumn(name, F.when(F.col(value) < 0, -F.col(size_)).otherwise(F.col(size_))).drop(abs_, near_, part_, size_)


def _decoded(code: Column) -> Column:
    c = F.abs(code)
    e, part = F.shiftright(c, 52), c.bitwiseAND(F.lit(_FRACTION - 1)).cast("double")
    a = (F.when(e == 2047, F.lit(float("inf"))).when(e == 0, part / _HALF_WAY / _HALF_WAY)
         .otherwise((part / float(_FRACTION) + 1) * F.pow(F.lit(2.0), (e - 1023).cast("double"))))
    return F.when(code < 0, -a).otherwise(a)


def radix_medians(long: DataFrame, group: Sequence[str] = (), few: int | None = None) -> DataFrame:
    """Exact medians ``_median`` per (group..., _var) of weighted values (group..., _var, _val, _cnt).

    ``long`` is read once a pass, so it should come from files by narrow operations.  Null groups are one group.
    """
    few = FEW if few is None else few
    seg = F.struct(*[F.col(c) for c in (*group, VAR)]).alias("_seg")  # one key, in which nulls are equal
    # a generator ends the pushing of filters, which would otherwise compute the code many times over
    coded = with_code(long).select(seg, F.explode(F.array("_code")).alias("_code"), CNT)
    kept, read, todo, local = None, None, list(SHIFTS), True
    while todo:
        left = todo.pop(0)
        src = coded
        if kept is not None:
            buckets = kept.select("_seg", F.col("_bucket").alias("_in")).distinct()
            src = coded.withColumn("_in", F.shiftright("_code", read)).join(buckets, ["_seg", "_in"])
        counts = (src.select("_seg", F.shiftright("_code", left).alias("_bucket"), CNT).groupBy("_seg", "_bucket")
                  .agg(F.sum(CNT).alias("_n")))
        if kept is None:
            whole = F.sum("_n").over(Window.partitionBy("_seg"))
            ranks = F.explode(F.array(F.struct(F.lit(0).alias("_end"), F.floor((F.col("_all") + 1) / 2).alias("_rank")),
                                      F.struct(F.lit(1).alias("_end"), (F.floor(F.col("_all") / 2) + 1).alias("_rank"))))
            upto = F.sum("_n").over(Window.partitionBy("_seg").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
            placed = (counts.select("*", whole.alias("_all"), upto.alias("_upto")).select("*", ranks.alias("_r"))
                      .select("_seg", "_bucket", "_n", "_upto", "_r.*"))
        else:
            inside = F.shiftright("_bucket", read - left).alias("_in")
            w = Window.partitionBy("_seg", "_in").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
            ends = kept.select("_seg", F.col("_bucket").alias("_in"), "_end", "_rank")
            placed = counts.select("*", inside).withColumn("_upto", F.sum("_n").over(w)).join(ends, ["_seg", "_in"])
        hit = (F.col("_upto") - F.col("_n") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))
        kept = placed.where(hit).select("_seg", "_bucket", "_n", "_end", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
        read, held = left, kept.limit(LOCAL + 1).collect() if local else ()
        local = local and len(held) <= LOCAL
        if local:
            kept = long.sparkSession.createDataFrame(held, kept.schema)
        else:
            kept = materialize(kept, "radix")
        if len(todo) > 1 and (sum(r["_n"] for r in held) if local else kept.agg(F.sum("_n")).first()[0] or 0) <= few:
            todo = todo[-1:]
    value = _decoded(F.col("_bucket"))
    ends = kept.groupBy("_seg").agg(F.max(F.when(F.col("_end") == 0, value)).alias("_lo"), F.max(F.when(F.col("_end") == 1, value)).alias("_hi"))
    middle = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(0.5))
    return ends.select("_seg.*", middle.alias("_median"))


def medians_long(df: DataFrame, cols: Sequence[str], group: Sequence[str] = (), few: int | None = None) -> DataFrame:
    """One row per (group..., _var) with the exact median ``_median`` (nulls skipped)."""
    return radix_medians(long_values(df, cols, group), group, few)


def widen_medians(long: DataFrame, cols: Sequence[str], group: Sequence[str] = (),
                  suffix: str = "") -> DataFrame:
    """Long medians -> one row per group (or exactly one row), a column per input column;
    written once, so that its consumers do not repeat the scan."""
    g = list(group)
    aggs = [F.max(F.when(F.col(VAR) == c, F.col("_median"))).alias(f"{c}{suffix}") for c in cols]
    # global: always exactly one row, even when every value is null
    return materialize(long.groupBy(*g).agg(*aggs) if g else long.agg(*aggs), "medians")


def medians_wide(df: DataFrame, cols: Sequence[str], group: Sequence[str] = (),
                 suffix: str = "", few: int | None = None) -> DataFrame:
    """One row per group (or exactly one row) with a median column per input column."""
    return widen_medians(medians_long(df, cols, list(group), few), cols, group, suffix)


def mode_value(df: DataFrame, c: str, alias: str | None = None) -> DataFrame:
    """One-row frame: most frequent non-null value of ``c``; ties -> smallest; none -> null."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_cnt"))
    return counts.agg(F.min_by(F.col(c), F.struct(-F.col("_cnt"), F.col(c))).alias(alias or c))


def modes_row(df: DataFrame, cols: Sequence[str], suffix: str = "__mode") -> DataFrame:
    """One-row frame with the mode of every column in ``cols`` (ties -> smallest value,
    all-null -> null), from ONE grouping-sets aggregate: a single scan and shuffle count
    the values of all columns, instead of one pass per column."""
    cols = list(cols)
    if len(cols) == 1:
        return mode_value(df, cols[0], f"{cols[0]}{suffix}")
    counts = df.groupingSets([[c] for c in cols], *cols).agg(
        F.count(F.lit(1)).alias("_cnt"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(cols)])

    def pick(i: int, c: str):
        mine = (F.col(f"_g{i}") == 0) & F.col(c).isNotNull()
        # min_by skips rows whose ordering is null: only this column's grouping set counts
        return F.min_by(F.col(c), F.when(mine, F.struct(-F.col("_cnt"), F.col(c)))).alias(f"{c}{suffix}")

    return counts.agg(*[pick(i, c) for i, c in enumerate(cols)])
