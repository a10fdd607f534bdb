"""Distribution drift between a reference and a current frame.

Numeric columns: exact two-sample Kolmogorov-Smirnov statistic and asymptotic
p-value, and the Wasserstein-1 distance normalised by the reference's population
std - both from one table of (column, value) -> (n_ref, n_cur) counts and its
bucketed running sums, so no column and no value range is processed by one task.
Categorical columns: Jensen-Shannon distance and PSI from per-category shares, and on demand the chi-square test of
equal shares or the z test of two proportions.

[choice] decision rules (the reference delegates them to a third-party preset):
numeric - ``test="wasserstein"`` (normalised distance >= 0.1) or ``test="ks"`` (p < 0.05),
named by the caller and the same at every size; categorical - Jensen-Shannon distance >= 0.1 (``test="js"``), or a
p-value below 0.05 (``test="chi2"``, and ``test="z"`` for columns of two categories).
NaN counts as missing.  A side without values gives null statistics and ``drifted`` false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.functions.tails import chi_square_tail, normal_tail
from panelrisk.operators.ordered import range_bucket, running_sums
from panelrisk.session import materialize
from panelrisk.spec import DRIFT_SHARE_THRESHOLD

VAR, VAL = "column", "_val"


def _present(cast: str) -> Column:
    return F.col(VAL).isNotNull() & ~F.isnan(VAL) if cast == "double" else F.col(VAL).isNotNull()


def _long(df: DataFrame, cols: Sequence[str], side: str, cast: str) -> DataFrame:
    return (df.select(*[F.col(c).cast(cast).alias(c) for c in cols])
            .unpivot([], list(cols), VAR, VAL)
            .where(_present(cast))
            .withColumn("_side", F.lit(side)))


def _side_counts(ref: DataFrame, cur: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    both = _long(ref, cols, "r", cast).unionByName(_long(cur, cols, "c", cast))
    return both.groupBy(VAR, VAL).agg(F.count_if(F.col("_side") == "r").alias("nr"),
                                      F.count_if(F.col("_side") == "c").alias("nc"))


def _split_counts(df: DataFrame, is_ref: Column, cols: Sequence[str], cast: str) -> DataFrame:
    """Side counts from ONE frame: ``is_ref`` true -> reference, false -> current, null ->
    neither.  One scan, where a union of two filtered frames would scan the input twice."""
    long = (df.select(is_ref.alias("_isr"), *[F.col(c).cast(cast).alias(c) for c in cols])
            .where(F.col("_isr").isNotNull())
            .unpivot(["_isr"], list(cols), VAR, VAL)
            .where(_present(cast)))
    return long.groupBy(VAR, VAL).agg(F.count_if(F.col("_isr")).alias("nr"),
                                      F.count_if(~F.col("_isr")).alias("nc"))


def ks_pvalue(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov distribution tail Q(lambda), lambda = (en + 0.12 + 0.11/en) * D."""
    en = F.sqrt(n * m / (n + m))
    lam = (en + F.lit(0.12) + F.lit(0.11) / en) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.lit(2.0) * F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.when(lam < 0.3, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def numeric_drift(ref: DataFrame, cur: DataFrame, cols: Sequence[str], alpha: float = 0.05,
                  wasserstein_threshold: float = 0.1, test: str = "wasserstein",
                  n_buckets: int | None = None) -> DataFrame:
    """K1: one row per numeric column."""
    return _numeric_drift(_side_counts(ref, cur, cols, "double"), alpha, wasserstein_threshold,
                          test, n_buckets, cols)


def numeric_drift_split(df: DataFrame, is_ref: Column, cols: Sequence[str], alpha: float = 0.05,
                        wasserstein_threshold: float = 0.1, test: str = "wasserstein",
                        n_buckets: int | None = None) -> DataFrame:
    """K1 when both sides are parts of one frame (``is_ref`` true / false): one scan."""
    return _numeric_drift(_split_counts(df, is_ref, cols, "double"), alpha, wasserstein_threshold,
                          test, n_buckets, cols)


def _numeric_drift(side_counts: DataFrame, alpha: float, wasserstein_threshold: float, test: str,
                   n_buckets: int | None, cols: Sequence[str]) -> DataFrame:
    if test not in ("wasserstein", "ks"):
        raise ValueError(f"unknown drift test: {test!r}")
    # (column, value) -> counts, written once: raw data is read a single time and the
    # cut points plus all branches below read this compact table
    counts = materialize(side_counts)
    v = F.col(VAL)
    ref = counts.where("nr > 0")
    means = ref.groupBy(VAR).agg((F.sum(F.col("nr") * v) / F.sum("nr")).alias("_mean"))  # one row per column
    # squares of centred values: no cancellation when values are large beside their spread
    spread = (ref.join(means, VAR).groupBy(VAR)
              .agg(F.sqrt(F.sum(F.col("nr") * (v - F.col("_mean")) * (v - F.col("_mean"))) / F.sum("nr")).alias("_sd")))
    j = (running_sums(range_bucket(counts, [VAL], n_buckets), [VAR], [VAL],
                      {"cr": F.col("nr"), "cc": F.col("nc")}, totals=True)
         .withColumnRenamed("cr_total", "_tr").withColumnRenamed("cc_total", "_tc"))
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    incl = F.abs(share("cr", "_tr") - share("cc", "_tc"))
    excl = F.abs((F.col("cr") - F.col("nr")) / F.nullif(F.col("_tr"), F.lit(0))
                 - (F.col("cc") - F.col("nc")) / F.nullif(F.col("_tc"), F.lit(0)))
    per = j.join(means, VAR, "left").groupBy(VAR).agg(
        F.first("_tr").alias("n_ref"), F.first("_tc").alias("n_cur"), F.max(incl).alias("ks_stat"),
        # W1 = sum_i d_i (x_{i+1} - x_i) = sum_i x_i (d_{i-1} - d_i), d_{i-1} = CDF gap just below x_i;
        # the gaps of a column cancel, so its values may be taken relative to their mean
        F.sum((v - F.coalesce("_mean", F.lit(0.0))) * (excl - incl)).alias("_w1"))
    listed = counts.sparkSession.createDataFrame([(c,) for c in cols], f"{VAR} string")
    out = (listed.join(per, VAR, "left").join(spread, VAR, "left")
           .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_ref", "n_cur")})
           .select(VAR, "n_ref", "n_cur", "ks_stat",
                   F.when(F.least("n_ref", "n_cur") > 0,
                          ks_pvalue(F.col("ks_stat"), F.greatest("n_ref", F.lit(1)).cast("double"),
                                    F.greatest("n_cur", F.lit(1)).cast("double"))).alias("p_value"),
                   (F.col("_w1") / F.nullif(F.col("_sd"), F.lit(0.0))).alias("wasserstein_norm")))
    drifted = F.col("wasserstein_norm") >= wasserstein_threshold if test == "wasserstein" else F.col("p_value") < alpha
    return out.withColumn("drifted", F.coalesce(drifted, F.lit(False)))


def categorical_drift(ref: DataFrame, cur: DataFrame, cols: Sequence[str], threshold: float = 0.1,
                      eps: float = 0.0001, test: str = "js", alpha: float = 0.05) -> DataFrame:
    """K2: Jensen-Shannon distance (natural log) and PSI per categorical column.

    ``test="chi2"`` adds the chi-square ``statistic`` of equal shares, its ``dof`` and ``p_value``; ``test="z"`` the z
    statistic of two proportions, null where a column hasn't two categories.  Both decide by ``alpha``.
    """
    return _categorical_drift(_side_counts(ref, cur, cols, "string"), threshold, eps, test, alpha)


def categorical_drift_split(df: DataFrame, is_ref: Column, cols: Sequence[str], threshold: float = 0.1,
                            eps: float = 0.0001, test: str = "js", alpha: float = 0.05) -> DataFrame:
    """K2 when both sides are parts of one frame (``is_ref`` true / false): one scan."""
    return _categorical_drift(_split_counts(df, is_ref, cols, "string"), threshold, eps, test, alpha)


def column_kinds(df: DataFrame, cols: Sequence[str], most: int = 5) -> tuple[list[str], list[str]]:
    """K5: (numbers, categories) among ``cols``: a numeric column of at most ``most`` values holds categories, as does any
    other column.  One aggregate with a sketch a column, which is exact at so few values."""
    cols = list(cols)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    if not cols:
        return [], []
    distinct = df.agg(*[F.approx_count_distinct(c, 0.01).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    numbers = [c for i, c in enumerate(cols) if c in numeric and distinct[i] > most]
    return numbers, [c for c in cols if c not in numbers]


def _categorical_drift(side_counts: DataFrame, threshold: float, eps: float, test: str = "js", alpha: float = 0.05) -> DataFrame:
    if test not in ("js", "chi2", "z"):
        raise ValueError(f"unknown drift test: {test!r}")
    counts = materialize(side_counts)
    tot = counts.groupBy(VAR).agg(F.sum("nr").alias("_tr"), F.sum("nc").alias("_tc")).withColumnRenamed(VAR, "_c")
    # one row per checked column (a plan-time list): a bounded broadcast
    j = counts.join(F.broadcast(tot), F.col(VAR) == F.col("_c"))
    p = F.col("nr") / F.nullif(F.col("_tr"), F.lit(0))
    q = F.col("nc") / F.nullif(F.col("_tc"), F.lit(0))
    m = (p + q) / 2

    def kl_term(a: Column) -> Column:
        return F.when(a > 0, a * F.log(a / m)).when(a == 0, F.lit(0.0))  # null without a side

    pe, qe = F.when(p.isNotNull(), F.greatest(p, F.lit(eps))), F.when(q.isNotNull(), F.greatest(q, F.lit(eps)))
    both = F.col("nr") + F.col("nc")
    er, ec = (both * F.col(t) / F.nullif(F.col("_tr") + F.col("_tc"), F.lit(0)) for t in ("_tr", "_tc"))
    square = lambda n, e: (n - e) * (n - e) / F.nullif(e, F.lit(0.0))
    per = j.groupBy(VAR).agg(
        F.count(F.lit(1)).alias("n_categories"),
        (0.5 * F.sum(kl_term(p)) + 0.5 * F.sum(kl_term(q))).alias("_js"),
        F.sum((qe - pe) * F.log(qe / pe)).alias("psi"),
        F.when(F.least(F.first("_tr"), F.first("_tc")) > 0, F.sum(square(F.col("nr"), er) + square(F.col("nc"), ec))).alias("_chi2"))
    distance = F.sqrt(F.when(F.col("_js") > 0, F.col("_js")).when(F.col("_js").isNotNull(), F.lit(0.0)))
    out = [VAR, "n_categories", distance.alias("js_distance"), "psi"]
    if test == "js":
        return per.select(*out).withColumn("drifted", F.coalesce(F.col("js_distance") >= threshold, F.lit(False)))
    dof = (F.col("n_categories") - 1).cast("int")
    if test == "chi2":
        tested = per.select(*out, F.col("_chi2").alias("statistic"), dof.alias("dof"), chi_square_tail(F.col("_chi2"), dof).alias("p_value"))
        tested = tested.withColumn("p_value", F.when(F.col("statistic").isNotNull(), F.col("p_value")))
    else:  # with two categories, the square of z is the chi-square statistic
        z = F.when(dof == 1, F.sqrt("_chi2"))
        tested = per.select(*out, z.alias("statistic"), normal_tail(z).alias("p_value"))
    return tested.withColumn("drifted", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def drift_summary(per_column: DataFrame, threshold: float = DRIFT_SHARE_THRESHOLD) -> DataFrame:
    """K3 + K4: share of drifted columns (0 when none), rounded to 4; alert when strictly
    above the threshold; the sorted list of drifted columns."""
    return per_column.agg(
        F.coalesce(F.round(F.count_if("drifted") / F.nullif(F.count(F.lit(1)), F.lit(0)), 4), F.lit(0.0))
        .alias("drift_score"),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col(VAR)))).alias("drifted_features"),
        F.count(F.lit(1)).alias("n_columns"),
    ).withColumn("drift_detected", F.col("drift_score") > threshold)
