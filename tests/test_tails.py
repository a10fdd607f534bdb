"""Tail probabilities against closed forms, and the tests of significance against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from panelrisk.functions.tails import chi_square_tail, ln_gamma, normal_tail
from panelrisk.operators import drift as D


def exact(x, dof):
    """The chi-square tail by its finite sums: of Poisson terms, and for odd degrees after the normal tail."""
    h = x / 2
    if dof % 2 == 0:
        return sum(math.exp(k * math.log(h) - h - math.lgamma(k + 1)) for k in range(dof // 2)) if h else 1.0
    return math.erfc(math.sqrt(h)) + (sum(math.exp((k + 0.5) * math.log(h) - h - math.lgamma(k + 1.5)) for k in range(dof // 2)) if h else 0.0)


def test_tails_and_gamma(spark):
    cases = [(x, dof) for dof in (1, 2, 3, 4, 7, 10, 25, 100, 999, 5000) for x in (0.0, 1e-6, 0.5, 1.0, 3.841458820694124, 6.634896601021213, 10.0,
                                                                              dof - 0.5, dof + 3.0, 1.5 * dof, 4.0 * dof)]
    df = spark.createDataFrame([(float(x), d) for x, d in cases], "x double, dof int")
    for r in df.select("x", "dof", chi_square_tail(F.col("x"), F.col("dof")).alias("p")).collect():
        assert r.p == pytest.approx(exact(r.x, r.dof), abs=1e-10), (r.x, r.dof)
    # the usual table's entries for 5 % and 1 %
    assert abs(exact(3.841458820694124, 1) - 0.05) < 1e-12 and abs(exact(6.634896601021213, 1) - 0.01) < 1e-12
    z = spark.createDataFrame([(float(v),) for v in (0.0, 0.3, 1.0, -1.959963984540054, 5.0, 30.0)], "z double")
    for r in z.select("z", normal_tail(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=1e-12)
    g = spark.createDataFrame([(v,) for v in (0.5, 1.0, 1.5, 2.0, 33.5, 2500.0)], "a double")
    for r in g.select("a", ln_gamma(F.col("a")).alias("v")).collect():
        assert r.v == pytest.approx(math.lgamma(r.a), abs=1e-9)
    odd = spark.createDataFrame([(None, 3), (2.0, 0), (2.0, None)], "x double, dof int").select(chi_square_tail(F.col("x"), F.col("dof")).alias("p"))
    assert [r.p for r in odd.collect()] == [None, 1.0, None]


def sides(spark):
    ref = [("a", "x")] * 40 + [("b", "y")] * 60 + [("a", None)] * 3
    cur = [("a", "x")] * 25 + [("b", "z")] * 25 + [(None, "x")] * 2
    schema = "two string, three string"
    return spark.createDataFrame(ref, schema), spark.createDataFrame(cur, schema)


def chi2(counts_r, counts_c):
    tr, tc = sum(counts_r), sum(counts_c)
    out = 0.0
    for r, c in zip(counts_r, counts_c):
        er, ec = tr * (r + c) / (tr + tc), tc * (r + c) / (tr + tc)
        out += (r - er) ** 2 / er + (c - ec) ** 2 / ec
    return out


def test_chi_square_and_z_between_two_frames(spark):
    ref, cur = sides(spark)
    got = {r.column: r for r in D.categorical_drift(ref, cur, ["two", "three"], test="chi2").collect()}
    for c, want, dof in (("two", chi2([43, 60], [25, 25]), 1), ("three", chi2([40, 60, 0], [27, 0, 25]), 2)):
        assert got[c].statistic == pytest.approx(want) and got[c].dof == dof
        assert got[c].p_value == pytest.approx(exact(want, dof), abs=1e-12) and got[c].drifted == (exact(want, dof) < 0.05)
    z = {r.column: r for r in D.categorical_drift(ref, cur, ["two", "three"], test="z").collect()}
    p = (43 + 25) / 153
    want = (43 / 103 - 25 / 50) / math.sqrt(p * (1 - p) * (1 / 103 + 1 / 50))
    assert z["two"].statistic == pytest.approx(abs(want)) and z["two"].p_value == pytest.approx(math.erfc(abs(want) / math.sqrt(2)))
    assert z["three"].statistic is None and z["three"].p_value is None and not z["three"].drifted  # not two categories
    with pytest.raises(ValueError, match="drift test"):
        D.categorical_drift(ref, cur, ["two"], test="t")


def test_sides_without_values_and_single_categories(spark):
    ref, cur = sides(spark)
    none = cur.filter("false")
    for test in ("chi2", "z"):
        assert [(r.p_value, r.drifted) for r in D.categorical_drift(ref, none, ["two"], test=test).collect()] == [(None, False)]
    one = D.categorical_drift(ref.filter("two = 'a'"), cur.filter("two = 'a'"), ["two"], test="chi2").first()
    assert (one.dof, one.p_value, one.drifted) == (0, 1.0, False)


def test_column_kinds(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("flag"), (F.col("id") % 5).alias("grade"), F.col("id").alias("many"),
                                  (F.col("id") % 6).alias("six"), F.lit(None).cast("double").alias("gone"), F.lit("t").alias("text"))
    assert D.column_kinds(df, ["flag", "grade", "many", "six", "gone"]) == (["many", "six"], ["flag", "grade", "gone"])
    assert D.column_kinds(df, ["many", "text"], most=0) == (["many"], ["text"])
    assert D.column_kinds(df, []) == ([], [])
