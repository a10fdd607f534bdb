"""Members chosen by a hash threshold: splits and samples that move no rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 4
MAX_SEGMENTS = 200


def smallest_hashes(df: DataFrame, segment: Sequence[str], hash_hex: Column, wanted, name: str) -> DataFrame | None:
    """``df`` with a boolean column: whether a row is among the ``wanted(n)`` rows of its segment with the smallest hashes.

    ``hash_hex`` is a uniform hex string without nulls, and ``wanted`` makes a count of rows (a column) out of the segment's.
    Rows are counted by segment and hash prefix (65,536 at most a segment); the prefix in which a segment's
    count is reached is looked at once more, hashes alone; then each row is decided where it is, by comparing its
    hash with a literal.  Only rows that share the very hash at the cut (one key repeated) are numbered.  No
    full row is shuffled otherwise.  None with more than ``MAX_SEGMENTS`` segments.
    """
    prefix = F.substring(hash_hex, 1, PREFIX_DIGITS)
    keys = [F.col(c).alias(f"_s{i}") for i, c in enumerate(segment)]
    seg = [f"_s{i}" for i in range(len(keys))]
    by_prefix = df.select(*keys, prefix.alias("_p")).groupBy(*seg, "_p").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*seg)
    upto = F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    cut = (by_prefix.select("*", upto.alias("_upto"), F.sum("_n").over(whole).alias("_all"))
           .withColumn("_k", wanted(F.col("_all"))).where((F.col("_upto") - F.col("_n") < F.col("_k")) & (F.col("_k") <= F.col("_upto")))
           .select(*seg, "_p", (F.col("_k") - F.col("_upto") + F.col("_n")).cast("long").alias("_rest")).limit(MAX_SEGMENTS + 1).collect())
    if len(cut) > MAX_SEGMENTS:
        return None

    def of(row):
        out = F.lit(True)
        for c, s in zip(segment, seg):
            out &= F.col(c).eqNullSafe(F.lit(row[s]))
        return out

    member, tied, numbers = F.lit(False), F.lit(False), F.lit(0)
    if cut:
        edge, rest = F.lit(False), F.lit(None).cast("long")
        for row in cut:
            edge |= of(row) & (prefix == row["_p"])
            rest = F.when(of(row), row["_rest"]).otherwise(rest)
        near = (df.where(edge).select(*keys, hash_hex.alias("_h"), rest.alias("_rest")).groupBy(*seg, "_h", "_rest")
                .agg(F.count(F.lit(1)).alias("_n")))
        w = whole.orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
        found = (near.withColumn("_upto", F.sum("_n").over(w))
                 .where((F.col("_upto") - F.col("_n") < F.col("_rest")) & (F.col("_rest") <= F.col("_upto")))
                 .select(*seg, "_h", "_n", (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_need")).collect())
        for row in found:
            if row["_n"] == row["_need"]:
                member |= of(row) & (hash_hex <= row["_h"])
            else:
                member |= of(row) & (hash_hex < row["_h"])
                tied |= of(row) & (hash_hex == row["_h"])
                numbers = F.when(of(row), row["_need"]).otherwise(numbers)
        if any(r["_n"] != r["_need"] for r in found):
            place = F.row_number().over(Window.partitionBy(*[F.col(c) for c in segment]).orderBy(hash_hex))
            some = df.where(tied).withColumn(name, place <= numbers)
            return df.where(~tied).withColumn(name, member).unionByName(some)
    return df.withColumn(name, member)
