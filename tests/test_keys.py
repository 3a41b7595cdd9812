"""Anti and semi joins by digests equal plain ones, with few and with many keys; edges without a partner are not shuffled."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import dedupe, keys, store
from codeloom.operators.traverse import written


def ids(df):
    return sorted(df.collect(), key=str)


@pytest.mark.parametrize("few", [0, 100])
@pytest.mark.parametrize("gone", [["1"], ["1", "2", "3", None], ["9"], []])
def test_joins_equal_plain_ones(spark, monkeypatch, few, gone):
    monkeypatch.setattr(keys, "FEW", few)
    df = spark.createDataFrame([("1", "x"), ("2", "x"), ("2", "y"), ("3", "x"), (None, "x"), ("4", None)], "a string, b string")
    k = spark.createDataFrame([(g,) for g in gone], "a string")
    assert ids(keys.without(df, (k, ["a"]))) == ids(df.join(k, "a", "left_anti"))
    assert ids(keys.within(df, k, ["a"])) == ids(df.join(k, "a", "left_semi"))


def test_upsert_of_new_edges_shuffles_no_stored_one(spark):
    old = written(spark.range(1000).selectExpr("'e' || id AS id", "id AS v"))
    new = written(spark.range(1000, 1010).selectExpr("'e' || id AS id", "id AS v"))
    out = store.upsert_edges(old, new)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1010


def test_edges_without_repeats_are_not_shuffled(spark):
    rows = spark.range(100).selectExpr("'e' || id AS id", "'f' || id AS fromNodeId", "'t' AS toNodeId", "'CALLS' AS relationshipType", "id AS pos")
    out = dedupe.edges(written(rows))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 100


def test_hashes_that_are_no_keys_rarely_pass(spark):
    """what passes a bitmap without being a key is shuffled, digested and joined; 12 in a thousand passed."""
    gone = spark.range(2000).selectExpr("xxhash64('k' || id) AS _h")
    rows = written(spark.range(200000).selectExpr("'r' || id AS id"))
    assert keys.possible(rows, F.xxhash64("id"), gone, 2000).count() < 400
    own = spark.range(2000).selectExpr("'k' || id AS id")
    assert keys.possible(own, F.xxhash64("id"), gone, 2000).count() == 2000


@pytest.mark.parametrize("crowded", [0, 2**24])
def test_bitmaps_let_all_keys_pass(spark, monkeypatch, crowded):
    """also where words are crowded, and with hashes of either sign."""
    monkeypatch.setattr(keys, "CROWDED", crowded)
    monkeypatch.setattr(keys, "MAX_BITS", 7)
    gone = spark.range(50).selectExpr("xxhash64('k' || id) AS _h")
    own = spark.range(50).selectExpr("'k' || id AS id")
    assert keys.possible(own, F.xxhash64("id"), gone, 50).count() == 50
