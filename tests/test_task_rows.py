"""Tasks of the projection's joins hold a bounded number of rows."""

from pyspark.sql import functions as F

from codeloom.operators import changes, dedupe, lookup
from codeloom.operators.traverse import written
from codeloom.plans import projection as pr
from codeloom.schema import FUNCTION, RELATIONSHIP, conform, empty_graph

DIR = "/root/testdata/sf0.01"


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(pr, "TASK_ROWS", 1000)
    lines = pr._lines(spark, DIR)
    total = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    held = lines.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.sum("count")).first()
    assert held[1] == total
    assert held[0] < 3000


def test_pairs_are_dealt_before_they_are_reduced(spark, monkeypatch):
    monkeypatch.setattr(pr, "TASK_ROWS", 1000)
    pairs = pr._pairs(spark, DIR)
    held = pairs.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.sum("count")).first()
    assert held[1] == spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().count()
    assert held[0] < 3000


def test_few_keys_are_not_sorted(spark):
    rows = spark.range(1000).selectExpr("'k' || id % 3 AS id", "id AS pos", "'v' || id AS v")
    out = dedupe.first_by(rows, ["id"])
    assert "ObjectHashAggregate" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(out.collect()) == [("k0", 0, "v0"), ("k1", 1, "v1"), ("k2", 2, "v2")]


def test_callers_of_changed_files_are_dealt_by_rows(spark, monkeypatch):
    """tasks of the join with callers are told by rows, and calls of other files' functions do not reach it."""
    monkeypatch.setattr(lookup, "TASK_ROWS", 100, raising=False)
    f = spark.range(1000).selectExpr("'f' || id AS id", "'p' AS projectName", "'d' || id || '.java' AS projectFilePath")
    r = spark.range(3000).selectExpr("'r' || id AS id", "'f' || id % 1000 AS fromNodeId", "'f' || id % 10 AS toNodeId", "'CALLS' AS relationshipType", "'CALL' AS relationshipKind", "'p' AS projectName")
    g = empty_graph(spark).with_(functions=written(conform(f, FUNCTION)), relationships=written(conform(r, RELATIONSHIP)))
    found = changes.dependents(g, "p", spark.createDataFrame([("d1.java",), ("d3.java",)], "path string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [fromNodeId") == 2 and ", 30" in plan
    assert "_bits" in plan
    assert {row["projectFilePath"] for row in found.collect()} == {f"d{i}.java" for i in range(1000) if i % 10 in (1, 3)} - {"d1.java", "d3.java"}
