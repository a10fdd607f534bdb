"""Every registered query runs at the smallest scale, agrees with its SQL, and the pipeline's stages keep the contract."""

import math
import os

import duckdb
import pytest

import corpus_pipeline
from panelrisk.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return list(v) if isinstance(v, (list, tuple)) else v


def test_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(repr([norm(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    assert rows
    if name in ORACLE:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(ORACLE[name])
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        at = [want.columns.index(c) for c in cols]
        assert rows == sorted(repr([norm(r[i]) for i in at]) for r in want.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = set(first)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out = corpus_pipeline.written(out, name)
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept
        if name == "line_dedup":
            assert set(ids) == kept
        kept, docs = set(ids), out
    assert 0.7 * len(first) < len(kept) < len(first)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == kept
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(last)


def test_pipeline_on_odd_tables(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10 ** 6, None, None, None, None), (10 ** 6 + 1, "", "en", "s", 0), (None, base.first()["text"], "en", "s", 1),
                                 (5, base.first()["text"], "en", "s", 1)], base.schema)
    docs = base.union(odd).selectExpr("*", "1 as score", "2 as fp", "3 as _text", "4 as rejected")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns[-4:] == ["score", "fp", "_text", "rejected"]
        assert stage(spark, docs.filter("false"), SF).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
