"""Registered queries against their SQL on a small table, and the pipeline's stages."""

import os

import pytest

import corpus_pipeline
from codeloom.llm import exact_dedup, minhash, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def normal(rows):
    return sorted(str(tuple("" if v is None or v != v else str(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert normal(tuple(r) for r in df.select(cols).collect()) == normal(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.cache().count()
        if name != "mixing":
            assert out.columns == columns
            assert rows <= docs.count()
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            good = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi").select("doc_id")
            assert good.join(out, "doc_id", "left_anti").count() <= 0.02 * good.count()
        if name == "exact_dedup":
            assert rows == docs.select("text").distinct().count() == out.select("text").distinct().count()
        if name == "near_dedup":
            assert minhash.near_duplicates(out, similarity=(80, 100)).filter("not kept").isEmpty()
            kept = out
    assert kept is not None and rows > 0
    assert exact_dedup.duplicates(kept).filter("not kept").isEmpty()
