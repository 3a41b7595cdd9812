"""Odd rows through all stages of the pipeline: nulls, repeats, long texts, clashing names, empty tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CLASHING = ("id", "key", "n", "label", "digest", "item", "salt", "hash", "row", "score", "kept", "spans", "cluster")


def table(spark):
    prose = "The river was calm in the morning, and people walked along it to the market to buy bread. "
    rows = [(i, prose * (3 + i % 4) + f"Day {i} was warm.", "en", "src1", 10) for i in range(30)]
    rows += [(100, None, "en", "src1", 0), (101, "", None, None, None), (None, prose * 2, "en", "src2", 5), (102, prose * 5, None, None, None), (102, prose * 5, None, None, None), (103, prose * 3000, "de", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(7) for c in CLASHING})


def test_all_stages(spark):
    docs = table(spark)
    columns, clean = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns[: len(columns)] == columns or set(columns) <= set(docs.columns)
        if name not in ("mixing",):
            assert docs.columns == columns
            assert docs.exceptAll(clean).isEmpty()
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == docs.count()
    assert not docs.isEmpty() and docs.filter("label <> 7").isEmpty()


def test_nothing(spark):
    docs = table(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.isEmpty()
