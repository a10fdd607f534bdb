"""Labels (L1-L6, A4) and features."""

import pytest
from pyspark.sql import functions as F

from panelrisk.operators.features import (
    add_all_below_median, add_gap, add_interactions, add_lag_diff, add_row_means, select_features,
    transform_features)
from panelrisk.operators.label import class_weights, encode_label, label_distribution
from panelrisk.spec import EDUCATION, EDUCATION_BASE_FEATURES, EDUCATION_ENGINEERED, EDUCATION_EXCLUDED

RULE = EDUCATION.label_rule
TEXT = EDUCATION.label_text_map


def _lab(spark, values, dtype):
    rows = [(i, v, 6.0 if i % 2 else 4.0, 6.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"id int, DEFASAGEM {dtype}, INDE double, IAN double")


def _labels(df):
    return [r.DEFASAGEM for r in encode_label(df, "DEFASAGEM", RULE, TEXT).orderBy("id").collect()]


def test_label_absent_derived_with_nulls(spark):
    df = spark.createDataFrame([(4.9, 6.0), (6.0, 4.0), (6.0, 6.0), (None, 6.0), (None, None), (5.0, 5.0)],
                               "INDE double, IAN double")
    got = [r.DEFASAGEM for r in encode_label(df, "DEFASAGEM", RULE, TEXT).collect()]
    assert got == [1, 1, 0, 0, 0, 0]


def test_label_text(spark):
    # even ids have INDE 4 -> derived 1 when the text is unknown
    assert _labels(_lab(spark, ["Sim", "não", "YES", "?", None, "Nao"], "string")) == [1, 0, 1, 0, 1, 0]


def test_label_binary_with_nulls(spark):
    assert _labels(_lab(spark, [1, 0, None, None], "int")) == [1, 0, 1, 0]


def test_label_signed(spark):
    assert _labels(_lab(spark, [-2, -1, 0, 1, 2, None], "int")) == [1, 1, 0, 0, 0, 0]


def test_label_all_null_is_binary(spark):
    assert _labels(_lab(spark, [None, None], "int")) == [1, 0]


def test_distribution_and_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    assert {r.y: r.n for r in label_distribution(df, "y").collect()} == {0: 6, 1: 2}
    w = {r.y: (r.weight, r.imbalance_ratio) for r in class_weights(df, "y").collect()}
    assert w[0] == pytest.approx((8 / 12, 3.0)) and w[1] == pytest.approx((2.0, 3.0))


def test_row_mean_gap_interactions(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "IPS double, IPP double, IPV double")
    out = add_row_means(df, {"M": ("IPS", "IPP", "IPV", "ABSENT")}).collect()
    assert out[0].M == 2.0 and out[1].M is None
    g = add_gap(spark.createDataFrame([(7.0, 5.0)], "IAA double, IDA double"), "IAA", "IDA", "GAP").first()
    assert g.GAP == 2.0
    i = add_interactions(spark.createDataFrame([(2.0, 3.0)], "a double, b double"),
                         [("a", "b", "ab"), ("a", "zz", "az")])
    assert i.columns == ["a", "b", "ab"] and i.first().ab == 6.0


def test_all_below_median_strict_and_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (1.0, None)], "a double, b double")
    out = add_all_below_median(df, ["a", "b"], "F").collect()
    # medians: a = 1.5, b = 2.0
    assert [r.F for r in out] == [1, 0, 0, 0]


@pytest.mark.parametrize("skew_safe", [True, False])
def test_lag_diff(spark, skew_safe):
    rows = [("x", 2021, 5.0), ("x", 2023, 8.0), ("x", 2022, None), ("y", 2022, 4.0),
            ("z", 2022, 1.0), ("z", 2022, 3.0), (None, 2022, 9.0), (None, 2023, 10.0)]
    df = spark.createDataFrame(rows, "NOME string, ANO int, INDE double")
    out = add_lag_diff(df, "INDE", "NOME", "ANO", "EVO", skew_safe=skew_safe, n_buckets=3).collect()
    got = sorted((r.NOME or "", r.ANO, r.INDE or -1, r.EVO) for r in out)
    assert got == sorted([("x", 2021, 5.0, 0.0), ("x", 2022, -1, 0.0), ("x", 2023, 8.0, 0.0),
                          ("y", 2022, 4.0, 0.0), ("z", 2022, 1.0, 0.0), ("z", 2022, 3.0, 2.0),
                          ("", 2022, 9.0, 0.0), ("", 2023, 10.0, 0.0)])


def test_lag_diff_without_entity(spark):
    df = spark.createDataFrame([(2021, 1.0)], "ANO int, INDE double")
    assert add_lag_diff(df, "INDE", None, "ANO", "EVO").first().EVO == 0.0


def test_transform_and_select(spark):
    rows = [(f"E{i % 5}", 2021 + i // 5, float(i % 7 + 2), 1.0 + i % 3, 5.0, 6.0, 7.0, 4.0, 5.0, 6.0, 8.0, 3.0)
            for i in range(15)]
    cols = "NOME string, ANO int, INDE double, FASE double, IAN double, IDA double, IEG double, IAA double, " \
           "IPS double, IPP double, IPV double, DEFASAGEM double"
    out = transform_features(spark.createDataFrame(rows, cols), EDUCATION)
    for c in EDUCATION_ENGINEERED:
        assert c in out.columns
    r = out.where("NOME = 'E1' AND ANO = 2022").first()
    prev = out.where("NOME = 'E1' AND ANO = 2021").first()
    assert r.EVOLUCAO_INDE == r.INDE - prev.INDE
    assert r.INDICE_BEMESTAR == pytest.approx((5.0 + 6.0 + 8.0) / 3)
    assert r.GAP_AUTO_REAL == -2.0 and r.INDE_x_FASE == r.INDE * r.FASE
    feats = select_features(out.withColumn("TURMA", F.lit("A")), EDUCATION_BASE_FEATURES, EDUCATION_ENGINEERED,
                            EDUCATION_EXCLUDED)
    assert feats[:3] == ["INDE", "IAN", "IDA"] and "TURMA" not in feats and "DEFASAGEM" not in feats
