"""Edges and ids to delete that are both many: each side is shuffled once, and none is written before."""

import pytest

from codeloom.operators import keys, store
from codeloom.operators.traverse import written
from codeloom.schema import RELATIONSHIP, conform


def edges(spark, first, last):
    return spark.range(first, last).selectExpr("'p::rel:' || sha1('' || id) AS id", "'CALLS' AS relationshipType", "'p' AS projectName")


def test_many_deleted_edges_are_shuffled_once(spark, monkeypatch):
    """their hashes and digests were written and joined first, then all rows with their digests."""
    monkeypatch.setattr(keys, "FEW", 100)
    seen = []
    monkeypatch.setattr(keys, "written", lambda df: seen.append(df.columns) or written(df))
    rows = conform(edges(spark, 0, 500), RELATIONSHIP).unionByName(conform(edges(spark, 500, 1000), RELATIONSHIP))
    out = store.delete_edges(rows, "p", edges(spark, 400, 1400).select("id")).select("id")
    assert not seen
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("Join") == 1 and "sha1" in plan
    assert sorted(r["id"] for r in out.collect()) == sorted(r["id"] for r in edges(spark, 0, 400).collect())


@pytest.mark.parametrize("few", [0, 100])
def test_deletion_equals_a_plain_join(spark, monkeypatch, few):
    """with ids that end in a digest, in capitals, in a line end or in none, empty and null ones, repeats and other projects."""
    monkeypatch.setattr(keys, "FEW", few)
    digest = "0123456789abcdef0123456789abcdef01234567"
    ids = [digest, f"r:{digest}", f"s:{digest}", f"r:{digest.upper()}", f"r:{digest}\n", f"a\n{digest}", f"r:{digest[1:]}", "r", "-", "", None]
    rows = spark.createDataFrame([(i, p, f"{n}") for n, i in enumerate(ids) for p in ("p", "p", "q", "", None)], "id string, projectName string, v string")
    for gone in ([f"r:{digest}"], ids, ids[::2] * 2, ids[1::2], ["x", None], []):
        g = spark.createDataFrame([(i,) for i in gone], "id string")
        plain = rows.join(g.selectExpr("id", "'p' AS projectName"), ["id", "projectName"], "left_anti").select(rows.columns)
        assert sorted(store.delete_edges(rows, "p", g).collect(), key=str) == sorted(plain.collect(), key=str)
    pairs = spark.createDataFrame([(i, p) for i in ids[:4] for p in ("q", None)], "id string, projectName string")
    assert sorted(keys.less(rows, pairs, ["id", "projectName"]).collect(), key=str) == sorted(rows.join(pairs, ["id", "projectName"], "left_anti").select(rows.columns).collect(), key=str)
