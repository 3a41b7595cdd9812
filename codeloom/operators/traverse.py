"""Bounded traversal of the graph and ranks by distance, as level-synchronous joins."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.ids import has_text

MAX_DEPTH = 12


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, as in tests, below a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
        base = sc.getCheckpointDir()
    return f"{base}/codeloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back; cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a written table that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> bool:
    """Whether df is files as they are, which cost no more to read again than a copy."""
    return df._jdf.queryExecution().optimizedPlan().children().isEmpty() and bool(df.inputFiles())


def direction_of(name: str | None) -> str:
    n = (name or "").strip().upper()
    return "FORWARD" if n in ("FORWARD", "OUT", "OUTGOING") else "BACKWARD" if n in ("BACKWARD", "IN", "INCOMING") else "BOTH"


def distances(edges: DataFrame, starts: DataFrame, direction: str = "BOTH", max_depth: int | None = 2) -> DataFrame:
    """(node, depth) of all nodes within max_depth of the start nodes, or of all that are reached if it is None; stops at an empty frontier.

    Every level joins the frontier with the edges and drops what was visited. The frontier
    is distinct before it is joined; whether it is broadcast is left to its size.
    """
    steps = []
    if direction in ("FORWARD", "BOTH"):
        steps.append(edges.select(F.col("fromNodeId").alias("node"), F.col("toNodeId").alias("next")))
    if direction in ("BACKWARD", "BOTH"):
        steps.append(edges.select(F.col("toNodeId").alias("node"), F.col("fromNodeId").alias("next")))
    step = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    seen = frontier = written(starts.select("node", F.lit(0).alias("depth")).distinct())
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        ahead = step.join(frontier.select("node"), "node", "left_semi").select(F.col("next").alias("node")).distinct()
        frontier = written(ahead.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def traverse(relationships: DataFrame, start: str | None, max_depth: int | None = None, direction: str | None = None, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, walked edges) from a start node: depth 2 if not given, else clamped to 1..12.

    An edge is walked if the end it leaves lies closer than the depth; of edges with the
    same ends and type the one with the smallest id is returned.
    """
    from codeloom.operators.dedupe import first_by

    depth = 2 if max_depth is None else max(1, min(max_depth, MAX_DEPTH))
    way = direction_of(direction)
    usable = relationships.filter(has_text(F.col("fromNodeId")) & has_text(F.col("toNodeId")))
    if types:
        usable = usable.filter(F.col("relationshipType").isin(list(types)))
    # Every level reads the edges, so they are built once.
    usable = written(usable.select("id", "fromNodeId", "toNodeId", "relationshipType", "lineNumber"))
    spark = relationships.sparkSession
    starts = spark.createDataFrame([(start,)] if start and start.strip() else [], "node string")
    found = distances(usable, starts, way, depth)
    inner = found.filter(F.col("depth") < depth).select("node")
    out = usable.join(inner.withColumnRenamed("node", "fromNodeId"), "fromNodeId", "left_semi")
    back = usable.join(inner.withColumnRenamed("node", "toNodeId"), "toNodeId", "left_semi")
    walked = {"FORWARD": out, "BACKWARD": back}.get(way) or out.unionByName(back)
    return found, first_by(walked.select(usable.columns), ["fromNodeId", "toNodeId", "relationshipType"], "id")


def ranks(relationships: DataFrame, nodes: DataFrame, start: str, types: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(id, rank): forward distance from the start; nodes that cannot be reached come one after the last rank."""
    usable = relationships.filter(F.col("relationshipType").isin(types)) if types else relationships
    usable = written(usable.select("fromNodeId", "toNodeId"))
    starts = relationships.sparkSession.createDataFrame([(start,)], "node string")
    found = distances(usable, starts, "FORWARD", max_depth)
    last = found.agg(F.greatest(F.max("depth"), F.lit(1)).alias("last"))
    return nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").join(F.broadcast(last)).select("id", F.coalesce("depth", F.col("last") + 1).alias("rank"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of an undirected graph given as (a, b) of longs: label is the component's smallest node."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = written(both.unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    label = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(label.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("m")).withColumnRenamed("x", "node")
        step = label.join(near, "node").select("node", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("moved"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = written(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "moved"))
        label = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return label
