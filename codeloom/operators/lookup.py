"""Lookups of a project's nodes and edges, set by set: one join answers many probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.ids import is_blank
from codeloom.operators.keys import possible
from codeloom.operators.traverse import stored

#: Rows of a table that a task of a join takes, however large the table is.
TASK_ROWS = 2**19


def of_project(df: DataFrame, project: str | None) -> DataFrame:
    return df.filter(F.col("projectName").eqNullSafe(F.lit(project)))


def in_file(nodes: DataFrame, project: str, path: str) -> DataFrame:
    return of_project(nodes, project).filter(F.col("projectFilePath") == path)


def by_id_or_name(nodes: DataFrame, project: str, wanted: DataFrame) -> DataFrame:
    """Rows whose id or qualifiedName is in the column `wanted`, each once: the first of an id."""
    own = of_project(nodes, project)
    w = wanted.select(F.col("wanted")).distinct()
    by_id = own.join(w.withColumnRenamed("wanted", "id"), "id", "left_semi")
    by_name = own.join(w.withColumnRenamed("wanted", "qualifiedName"), "qualifiedName", "left_semi")
    return by_id.unionByName(by_name).dropDuplicates(["id"])


def existing_ids(nodes: DataFrame, project: str, wanted: DataFrame) -> DataFrame:
    """Distinct ids of nodes whose id or qualifiedName is wanted."""
    own, w = of_project(nodes, project), wanted.select("wanted").distinct()
    by_id = own.select("id").join(w, F.col("id") == F.col("wanted"), "left_semi")
    by_name = own.select("id", "qualifiedName").join(w, F.col("qualifiedName") == F.col("wanted"), "left_semi").select("id")
    return by_id.unionByName(by_name).distinct()


def existing_endpoints(endpoints: DataFrame, project: str, wanted: DataFrame) -> DataFrame:
    """By id only."""
    own = of_project(endpoints, project).select("id")
    return own.join(wanted.select(F.col("wanted").alias("id")), "id", "left_semi").distinct()


def by_direction(endpoints: DataFrame, project: str, direction: str) -> DataFrame:
    return of_project(endpoints, project).filter(F.col("direction") == direction)


def by_identity(endpoints: DataFrame, identity: str, direction: str | None = None) -> DataFrame:
    """Of all projects; a blank direction is any."""
    found = endpoints.filter(F.col("matchIdentity") == identity)
    return found.filter(F.col("direction") == direction) if direction and direction.strip() else found


def outgoing(relationships: DataFrame, project: str, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Edges that leave the nodes of the column `node`; a blank type is any."""
    own = of_project(relationships, project)
    own = own.filter(F.col("relationshipType") == kind) if kind and kind.strip() else own
    return own.join(nodes.select(F.col("node").alias("fromNodeId")).distinct(), "fromNodeId", "left_semi")


def incoming(relationships: DataFrame, project: str, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    own = of_project(relationships, project)
    own = own.filter(F.col("relationshipType") == kind) if kind and kind.strip() else own
    return own.join(nodes.select(F.col("node").alias("toNodeId")).distinct(), "toNodeId", "left_semi")


EDGE_KEY = ["fromNodeId", "toNodeId", "relationshipType"]


def existing_edge_keys(relationships: DataFrame, project: str, wanted: DataFrame) -> DataFrame:
    """from:to:type of the wanted edges that the project has."""
    own = of_project(relationships, project).select(*EDGE_KEY)
    return own.join(wanted.select(*EDGE_KEY), EDGE_KEY, "left_semi").select(F.concat_ws(":", *EDGE_KEY).alias("edge_key")).distinct()


FILE = ["projectFilePath", "gitRepoUrl", "gitBranch"]


def callers_of_files(functions: DataFrame, relationships: DataFrame, project: str, paths: DataFrame | None = None) -> DataFrame:
    """(callee_file, projectFilePath, gitRepoUrl, gitBranch): files with functions that call functions of each file.

    Callees are the project's, callers are found by id alone. paths: the files asked for,
    in a column `path`; all files if None. Only columns of the join are read, and calls
    are reduced to distinct pairs of caller and file before callers are looked up. With
    paths, calls of other functions stay out of the shuffle, and callers are dealt by rows:
    adaptive tasks are told by compressed bytes, which are millions of rows that repeat so much.
    """
    callee = of_project(functions, project).select(F.col("id").alias("toNodeId"), F.col("projectFilePath").alias("callee_file")).filter("callee_file is not null")
    call = of_project(relationships, project).filter(F.col("relationshipKind").eqNullSafe("CALL") | (is_blank(F.col("relationshipKind")) & (F.col("relationshipType") == "CALLS"))).select("fromNodeId", "toNodeId")
    caller = functions.select(F.col("id").alias("fromNodeId"), *FILE)
    if paths is not None:
        callee = callee.join(paths.select(F.col("path").alias("callee_file")), "callee_file", "left_semi")
        n = functions.count()
        call = possible(call, F.xxhash64("toNodeId"), callee.select(F.xxhash64("toNodeId").alias("_h")), n)
        rows = max(n, relationships.count()) if stored(relationships) else n
        tasks = max(functions.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    pair = call.join(callee, "toNodeId").select("fromNodeId", "callee_file")
    if paths is not None:
        pair, caller = pair.repartition(tasks, "fromNodeId"), caller.repartition(tasks, "fromNodeId")
    return pair.distinct().join(caller, "fromNodeId").select("callee_file", *FILE).distinct()


def calling_files(functions: DataFrame, relationships: DataFrame, project: str, paths: DataFrame | None = None) -> DataFrame:
    return callers_of_files(functions, relationships, project, paths).select("callee_file", "projectFilePath").distinct()
