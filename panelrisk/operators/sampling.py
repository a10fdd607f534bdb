"""Reproducible splitting and sampling.

Membership is decided by ``md5('<seed>:' || key)``: portable (DuckDB computes the
same hash), deterministic under task retries, and uniform, so equal-width buckets of
the hash are balanced.  Splits and samples find the hash at which a class's count is reached and compare every
row with it (``thresholds.smallest_hashes``): no full row is shuffled.  The ranks of folds come from
``ordered.hash_rank``: no class and no global order is ever processed by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.operators.ordered import hash_rank
from panelrisk.operators.thresholds import smallest_hashes


def seeded_hash(key: str | Column, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def _member_hash(df: DataFrame, key: str, seed: int) -> Column:
    """The key's hash; rows without a key are placed by a hash of the whole row, so none is lost
    and they do not share one place."""
    whole = [F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.coalesce(seeded_hash(key, seed), F.md5(F.concat(F.lit(f"{seed}:null:"), F.xxhash64(*whole).cast("string"))))


def stratified_split(df: DataFrame, label: str, key: str, test_frac: float = 0.2, seed: int = 42,
                     name: str = "split", n_buckets: int | None = None) -> DataFrame:
    """Per class, the ceil(test_frac * n_class) rows with the smallest hash are 'test'."""
    if label not in df.columns:
        raise ValueError(f"label column {label!r} not found; encode the label first")
    marked = smallest_hashes(df, [label], _member_hash(df, key, seed), lambda n: F.ceil(F.lit(test_frac) * n), "_test")
    if marked is not None:
        return marked.withColumn(name, F.when(F.col("_test"), "test").otherwise("train")).drop("_test")
    # a label of very many values: ranks within each
    ranked = hash_rank(df, [label], _member_hash(df, key, seed), [key], "_rk", n_buckets, totals=True)
    test = F.col("_rk") <= F.ceil(F.lit(test_frac) * F.col("_rk_total"))
    return ranked.withColumn(name, F.when(test, "test").otherwise("train")).drop("_rk", "_rk_total")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                     name: str = "fold", n_buckets: int | None = None) -> DataFrame:
    """fold = (rank within class - 1) mod k: class shares equal in every fold."""
    ranked = hash_rank(df, [label], _member_hash(df, key, seed), [key], "_rk", n_buckets)
    return ranked.withColumn(name, ((F.col("_rk") - 1) % k).cast("int")).drop("_rk")


def exact_sample(df: DataFrame, key: str, frac: float = 0.3, seed: int = 99) -> DataFrame:
    """Exactly round(frac * n) rows without replacement - the smallest hashes.

    Not ``orderBy().limit(n)``: n grows with the data and a limit that large funnels
    into one task.  The hash at the cut is found first, and n from the same counts.
    """
    marked = smallest_hashes(df, [], _member_hash(df, key, seed), lambda n: F.round(F.lit(frac) * n), "_drawn")
    return marked.where("_drawn").drop("_drawn")


def bernoulli_sample(df: DataFrame, frac: float, seed: int = 99) -> DataFrame:
    """Fast approximate variant of T3 (size is binomial, not exact)."""
    return df.sample(withReplacement=False, fraction=frac, seed=seed)


def split_frames(df: DataFrame, name: str = "split") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(name) == "train").drop(name), df.where(F.col(name) == "test").drop(name)


def features_and_label(df: DataFrame, label: str) -> tuple[DataFrame, Sequence[str]]:
    """X/y separation is a column list in Spark; the label stays on the row."""
    return df, [c for c in df.columns if c != label]
