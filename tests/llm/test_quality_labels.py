"""The quality classifier against labels that it never sees, and the bounds of its sample."""

import os

import pytest
from pyspark.sql import functions as F

from codeloom.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_labels_are_recovered(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.scored(docs, quality.train(docs)).select("doc_id", "kept").join(labels, "doc_id")
    got = {(r["quality"], r["kept"]): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    good, bad = got.get((1, True), 0) + got.get((1, False), 0), got.get((0, True), 0) + got.get((0, False), 0)
    assert good > 100 and bad > 10
    assert got.get((1, True), 0) >= 0.98 * good, got
    assert got.get((0, False), 0) >= 0.9 * bad, got


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_BYTES", 64_000)
    seen, measure = [], quality.measure
    monkeypatch.setattr(quality, "measure", lambda text: seen.append(len(text)) or measure(text))
    good = "The river was calm in the morning, and people walked along it to the market. "
    docs = spark.createDataFrame([(i, good * (1 + i % 9)) for i in range(400)] + [(500, good * 10_000)], "doc_id long, text string")
    quality.train(docs)
    assert 50 < len(seen) < 400 and sum(seen) <= 64_000 and max(seen) <= 4000
    assert quality.train(docs.limit(0)).weights is None
    assert quality.train(docs.filter(F.length("text") > 10_000)).weights is None
