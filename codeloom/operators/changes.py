"""Change events on files: dependents, placeholders for unknown callees, cascades, dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.ids import display_name, has_text, method_name, signature_of
from codeloom.operators import store
from codeloom.operators.delta import apply, split_by_kind
from codeloom.operators.keys import FEW, within, without
from codeloom.operators.lookup import FILE, callers_of_files, in_file, of_project
from codeloom.operators.traverse import written
from codeloom.schema import FUNCTION, RELATIONSHIP, Graph, conform

CHANGES = ("SOURCE_ADDED", "SOURCE_MODIFIED", "SOURCE_DELETED", "CASCADE_UPDATE")


def placeholders(functions: DataFrame, calls: DataFrame, project: str, with_project: bool = False) -> DataFrame:
    """Placeholder functions for ends of calls that the project does not have.

    They carry no project, as the stored form has it, unless with_project asks for one; their
    language is that of the first call (smallest id) that needs them.
    """
    ends = calls.select("id", "language", F.explode(F.array("fromNodeId", "toNodeId")).alias("node")).filter(has_text(F.col("node")))
    have = of_project(functions, project).select(F.col("id").alias("node"))
    # Beside few ends no function is shuffled; many meet them as they are.
    lacking = without(ends, (have, ["node"])) if calls.count() <= FEW // 2 else ends.join(have, "node", "left_anti")
    one = lacking.groupBy("node").agg(F.min_by("language", "id").alias("language"))
    q = display_name(F.col("node"))
    out = one.select(
        F.col("node").alias("id"), method_name(q).alias("name"), q.alias("qualifiedName"), "language", signature_of(q).alias("signature"), F.lit(True).alias("isPlaceholder"),
        (F.lit(project) if with_project else F.lit(None).cast("string")).alias("projectName"),
    )
    return conform(out, FUNCTION)


def rebuild_calls(graph: Graph, calls: DataFrame, project: str, pos: str | None = None, with_project: bool = False) -> Graph:
    """Adds missing placeholders, then upserts all calls: of repeated ones the last wins."""
    extra = written(placeholders(graph.functions, calls, project, with_project))
    have = graph.with_(functions=store.insert_missing(graph.functions, extra))
    return have.with_(relationships=store.upsert_edges(graph.relationships, conform(calls, RELATIONSHIP, *([pos] if pos else [])), pos))


def dependents(graph: Graph, project: str, files: DataFrame) -> DataFrame:
    """Files that call functions of the changed files (column `path`), without these themselves."""
    found = callers_of_files(graph.functions, graph.relationships, project, files)
    return found.select(*FILE).distinct().join(files.select(F.col("path").alias("projectFilePath")), "projectFilePath", "left_anti")


def cascade_events(graph: Graph, project: str, files: DataFrame) -> DataFrame:
    """One CASCADE_UPDATE event for each dependent file."""
    return dependents(graph, project, files).select(
        F.uuid().alias("eventId"), F.lit(project).alias("projectName"), F.lit("CASCADE_UPDATE").alias("changeType"), F.col("projectFilePath").alias("newProjectFilePath"), "gitRepoUrl", "gitBranch",
        F.lit("callee changed").alias("reason"), F.current_timestamp().cast("timestamp_ntz").alias("timestamp"),
    )


def nodes_of_files(graph: Graph, project: str, files: DataFrame) -> DataFrame:
    """Ids of units, functions and endpoints in the files; packages survive their files."""
    own = [of_project(t, project).select("id", F.col("projectFilePath").alias("path")) for t in (graph.units, graph.functions, graph.endpoints)]
    both = own[0].unionByName(own[1]).unionByName(own[2])
    return within(both, written(files.select("path").distinct()), ["path"]).select("id").distinct()


def added(graph: Graph, delta: Graph, project: str) -> tuple[Graph, DataFrame]:
    """New files: their delta, then its calls."""
    from codeloom.operators.delta import rescoped

    out, events = apply(graph, delta, project)
    calls = split_by_kind(rescoped(delta, project).relationships)[1]
    return rebuild_calls(out, calls, project, "pos"), events


def modified(graph: Graph, delta: Graph, project: str, files: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """Changed files: old nodes go, the delta comes, and calls of other files into them that still find their callee stay.

    Returns the cascade events too. Deleting before dependents are rebuilt keeps their edges.
    """
    cascade = cascade_events(graph, project, files)
    old = written(nodes_of_files(graph, project, files))
    incoming = of_project(graph.relationships, project).filter("relationshipKind = 'CALL'")
    incoming = written(within(incoming, old.withColumnRenamed("id", "toNodeId"), ["toNodeId"]))
    incoming = without(incoming, (old.withColumnRenamed("id", "fromNodeId"), ["fromNodeId"]))
    out, events = added(store.delete_nodes(graph, project, old), delta, project)
    back = within(incoming, out.functions.select(F.col("id").alias("toNodeId")), ["toNodeId"])
    back = without(written(back), (out.relationships, ["id"]))
    return out.with_(relationships=out.relationships.unionByName(back.select(out.relationships.columns))), events, cascade


def removed(graph: Graph, project: str, files: DataFrame) -> tuple[Graph, DataFrame]:
    """Deleted files: their nodes and edges go; dependents are to be updated afterwards."""
    cascade = cascade_events(graph, project, files)
    return store.delete_nodes(graph, project, nodes_of_files(graph, project, files)), cascade


def cascaded(graph: Graph, calls: DataFrame, project: str, files: DataFrame) -> Graph:
    """Dependent files: their calls are dropped and rebuilt from a fresh parse."""
    rel = store.delete_file_calls(graph.relationships, graph.functions, project, files)
    return rebuild_calls(graph.with_(relationships=rel), calls, project)


def handle(graph: Graph, change: str, project: str, files: DataFrame, delta: Graph | None = None) -> Graph:
    """The graph after a change of the files; unknown kinds of change are an error."""
    if change == "SOURCE_ADDED":
        return added(graph, delta, project)[0]
    if change == "SOURCE_MODIFIED":
        return modified(graph, delta, project, files)[0]
    if change == "SOURCE_DELETED":
        return removed(graph, project, files)[0]
    if change == "CASCADE_UPDATE":
        return cascaded(graph, split_by_kind(delta.relationships)[1], project, files)
    raise ValueError(f"unsupported change type: {change}")


__all__ = ["CHANGES", "added", "cascade_events", "cascaded", "dependents", "handle", "in_file", "modified", "nodes_of_files", "placeholders", "rebuild_calls", "removed"]
