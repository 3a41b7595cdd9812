"""Ranks have no limit of levels."""

import inspect

from codeloom.operators import traverse


def test_distances_without_a_depth_run_to_the_last_node(spark):
    assert inspect.signature(traverse.ranks).parameters["max_depth"].default is None
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)], "fromNodeId string, toNodeId string")
    starts = spark.createDataFrame([("n0",)], "node string")
    got = {r["node"]: r["depth"] for r in traverse.distances(edges, starts, "FORWARD", None).collect()}
    assert got == {f"n{i}": i for i in range(6)}
