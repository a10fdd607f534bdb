"""Schema, reshape and dedup operators."""

import pytest
from pyspark.sql import functions as F

from panelrisk.operators.panel import (
    EDUCATION_LAYOUT, concat_panels, discover_periods, is_wide, normalize_column_names, project_known,
    remove_duplicates, validate_schema, wide_to_long)
from panelrisk.spec import EDUCATION


def test_normalize_names(spark):
    df = spark.createDataFrame([(1, 2)], "`  nome aluno ` int, `Fase\tTurma` int")
    assert normalize_column_names(df).columns == ["NOME_ALUNO", "FASE_TURMA"]
    assert df.columns == ["  nome aluno ", "Fase\tTurma"]  # input untouched


def test_normalize_collision_raises(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, `A  B` int")
    with pytest.raises(ValueError):
        normalize_column_names(df)


@pytest.mark.parametrize("missing", sorted(EDUCATION.required))
def test_validate_schema_missing(spark, missing):
    cols = [c for c in sorted(EDUCATION.required) if c != missing]
    df = spark.createDataFrame([tuple(range(len(cols)))], ", ".join(f"{c} int" for c in cols))
    with pytest.raises(ValueError, match=missing):
        validate_schema(df, EDUCATION.required)


def test_wide_detection_and_periods():
    assert is_wide(["NOME", "INDE_2022"]) and not is_wide(["NOME", "INDE"])
    assert discover_periods(["INDE_2022", "IAN_2021", "X_2021", "Y"]) == [2021, 2022]


def _wide(spark):
    rows = []
    for i in range(20):
        rows.append((f"EST_{i:03d}", 5.0 + i % 4, 6.0, "7G" if i % 2 else "X", "A", "Sim" if i % 2 else "Não",
                     -1, 7.0 + i % 3, "8", 5.5, "Não"))
    schema = ("NOME string, INDE_2021 double, IAN_2021 double, FASE_TURMA_2021 string, TURMA_2021 string, "
              "PONTO_VIRADA_2021 string, DEFASAGEM_2021 int, INDE_2022 double, FASE_2022 string, "
              "IAN_2022 double, PONTO_DE_VIRADA_2022 string")
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("IDA_2020", F.lit(1.0))  # a year without INDE: skipped


def test_wide_to_long(spark):
    long = wide_to_long(_wide(spark), EDUCATION_LAYOUT)
    assert long.count() == 40
    assert sorted(r.ANO for r in long.select("ANO").distinct().collect()) == [2021, 2022]
    r21 = long.where("NOME = 'EST_001' AND ANO = 2021").first()
    assert r21.FASE == 7.0 and r21.TURMA == "A" and r21.PONTO_DE_VIRADA == "Sim" and r21.DEFASAGEM == -1.0
    r22 = long.where("NOME = 'EST_000' AND ANO = 2022").first()
    assert r22.FASE == 8.0 and r22.TURMA is None and r22.DEFASAGEM is None and r22.PONTO_DE_VIRADA == "Não"
    assert long.where("NOME = 'EST_000' AND ANO = 2021").first().FASE is None  # 'X' has no digits
    assert "IDA" not in long.columns or long.where("ANO = 2020").count() == 0


def test_wide_to_long_no_anchor_returns_input(spark):
    df = spark.createDataFrame([("a", 1.0)], "NOME string, IAN_2021 double")
    assert wide_to_long(df, EDUCATION_LAYOUT).columns == df.columns


def test_wide_text_indicator_is_coerced(spark):
    df = spark.createDataFrame([("a", "7,5"), ("b", "6.5")], "NOME string, INDE_2022 string")
    got = {r.NOME: r.INDE for r in wide_to_long(df, EDUCATION_LAYOUT).collect()}
    assert got == {"a": None, "b": 6.5}


def test_concat_and_dedup(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2,)], "k int")
    u = concat_panels([a, b])
    assert sorted(u.collect()) == sorted([(1, "x"), (2, None)])
    d = spark.createDataFrame([(1, None), (1, None), (1, 2.0)], "a int, b double")
    assert remove_duplicates(d).count() == 2


def test_project_known(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert project_known(df, ["b", "zzz", "a"]).columns == ["b", "a"]
