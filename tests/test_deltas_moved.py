"""Deltas and deletions write new edges once and join stored rows only where hashes cannot tell."""

from codeloom.operators import delta, keys
from codeloom.operators.traverse import written
from codeloom.schema import FUNCTION, RELATIONSHIP, conform, empty_graph


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_keys_go_without_a_join_of_rows(spark):
    """each value meets the keys once, whatever the number of its rows."""
    rows = written(spark.range(1000).selectExpr("'e' || id AS id", "'n' || id % 10 AS toNodeId"))
    gone = spark.createDataFrame([("n1",), ("n3",), (None,)], "toNodeId string")
    out = keys.without(rows, (gone, ["toNodeId"]))
    assert "LeftAnti" not in plan(out)
    assert out.count() == 800
    kept = keys.within(rows, gone, ["toNodeId"])
    assert "LeftSemi" not in plan(kept)
    assert kept.count() == 200


def test_many_keys_that_meet_none_are_not_digested(spark, monkeypatch):
    """of two large sides only hashes meet."""
    monkeypatch.setattr(keys, "FEW", 100)
    seen = []
    monkeypatch.setattr(keys, "written", lambda df: seen.append(df.columns) or written(df))
    a, b = spark.range(500).selectExpr("'a' || id AS id"), spark.range(400).selectExpr("'b' || id AS id")
    assert keys.without(a, (b, ["id"])) is a
    assert seen and all("_d" not in c for c in seen)


def test_calls_of_a_delta_are_not_written_again_and_stored_functions_not_joined(spark, monkeypatch):
    """F2, F15."""
    old = written(conform(spark.range(50).selectExpr("'p::f' || id AS id", "'p' AS projectName"), FUNCTION))
    edges = written(conform(spark.range(5).selectExpr("'p::r' || id AS id", "'p::f' || id AS fromNodeId", "'p::f0' AS toNodeId", "'CALLS' AS relationshipType", "'p' AS projectName"), RELATIONSHIP))
    none = {t: df.selectExpr("*", "0L AS pos") for t, df in empty_graph(spark).tables().items()}
    fn = conform(spark.range(1).selectExpr("'g' AS id", "'g' AS name"), FUNCTION).selectExpr("*", "0L AS pos")
    call = conform(spark.range(1).selectExpr("'n' AS id", "'g' AS fromNodeId", "'f1' AS toNodeId", "'CALLS' AS relationshipType", "'java' AS language"), RELATIONSHIP).selectExpr("*", "0L AS pos")
    new = empty_graph(spark).with_(**none).with_(functions=fn, relationships=call)
    seen = []
    monkeypatch.setattr(delta, "written", lambda df: seen.append(df.columns) or written(df))
    out = delta.apply(empty_graph(spark).with_(functions=old, relationships=edges), new, "p", validate=False)[0]
    assert seen.count(RELATIONSHIP.names) == 1  # match edges
    assert sorted(r["id"] for r in out.relationships.collect()) == sorted([f"p::r{i}" for i in range(5)] + ["p::n"])
    assert "LeftAnti" not in plan(out.functions)
    assert out.functions.count() == 51
