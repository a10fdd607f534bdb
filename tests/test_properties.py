"""Property-based checks: the bucketed scans equal the single-window definitions on
random frames with a hot segment, null segment keys and repeated leading values."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelrisk.operators.ordered import range_bucket, running_sums, segmented_lag

rows_strategy = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(0, 3), st.just(0), st.just(0)),   # segment, 0 is hot
              st.integers(0, 6),                                                # leading order value
              st.floats(-50, 50, allow_nan=False).map(lambda x: round(x, 2))),  # value
    min_size=1, max_size=120)


def _frame(spark, rows):
    data = [(s, p, v, i) for i, (s, p, v) in enumerate(rows)]
    return spark.createDataFrame(data, "s int, p int, v double, tie int")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, buckets=st.integers(1, 9))
def test_segmented_lag_property(spark, rows, buckets):
    df = _frame(spark, rows)
    got = segmented_lag(df, ["s"], [F.col("p"), F.col("tie")], {"prev": "v"}, n_buckets=buckets)
    want = df.withColumn("prev", F.lag("v").over(Window.partitionBy("s").orderBy("p", "tie")))
    assert sorted(got.collect(), key=str) == sorted(want.select(*got.columns).collect(), key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, buckets=st.integers(1, 9), exclusive=st.booleans())
def test_running_sums_property(spark, rows, buckets, exclusive):
    df = _frame(spark, rows)
    got = running_sums(range_bucket(df, ["p", "tie"], buckets), ["s"], ["p", "tie"],
                       {"cs": F.col("v")}, exclusive=exclusive, totals=True).drop("_bucket")
    w = Window.partitionBy("s").orderBy("p", "tie").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    want = (df.withColumn("cs", F.coalesce(F.sum("v").over(w), F.lit(0.0)))
            .withColumn("cs_total", F.sum("v").over(Window.partitionBy("s"))))
    g = sorted(((r.s, r.tie, round(r.cs, 6), round(r.cs_total, 6)) for r in got.collect()), key=str)
    e = sorted(((r.s, r.tie, round(r.cs, 6), round(r.cs_total, 6)) for r in want.collect()), key=str)
    assert g == e


impute_rows = st.lists(
    st.tuples(st.one_of(st.none(), st.sampled_from([1.0, 2.0, 3.0]), st.just(1.0), st.just(1.0)),  # 1.0 is hot
              st.one_of(st.none(), st.integers(-3, 3).map(float)),                                # ties
              st.one_of(st.none(), st.floats(-9, 9, allow_nan=False).map(lambda x: round(x, 1)))),
    min_size=1, max_size=80)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=impute_rows, overwrite=st.booleans())
def test_group_median_impute_property(spark, rows, overwrite):
    from panelrisk.operators.clean import impute_group_median
    from tests.test_clean import _brute_group_median, _null_first
    mode = "overwrite" if overwrite else "keep"
    df = spark.createDataFrame(rows, "g double, a double, b double")
    got = sorted((tuple(r) for r in impute_group_median(df, ["a", "b"], "g", mode).collect()), key=_null_first)
    want = _brute_group_median(rows, ["a", "b"], mode)
    assert len(got) == len(want)
    for x, y in zip(got, want):
        assert x[0] == y[0]
        assert all((u is None and v is None) or (u is not None and v is not None and abs(u - v) < 1e-9)
                   for u, v in zip(x[1:], y[1:])), (x, y)
