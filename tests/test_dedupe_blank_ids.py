"""Edges without an id are compared by ends and type alone."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import dedupe


def fold(rows):
    ids, keys, want = set(), set(), []
    for i, f, t, k, pos in sorted(rows, key=lambda r: r[4]):
        ident, key = (i if i and i.strip() else None), (f or "", t or "", k or "")
        if ident not in ids and key not in keys:
            want.append(pos)
            keys.add(key)
            if ident:
                ids.add(ident)
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_without_ids(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, "", " ", "i1", "i2", "i3"]), r.choice(["a", "b", None, ""]), r.choice("xyz"), "CALLS", pos) for pos in range(40)]
    if seed == 2:
        rows = [(None, f"n{i % 7}", "m", "CALLS", i) for i in range(20)] + [("i", "n0", "m", "CALLS", 30)]
    df = spark.createDataFrame(rows, "id string, fromNodeId string, toNodeId string, relationshipType string, pos long").withColumn("attributes", F.create_map(F.lit("k"), F.lit("v")))
    got = dedupe.edges(df)
    assert got.columns == df.columns and sorted(x["pos"] for x in got.collect()) == fold(rows)
