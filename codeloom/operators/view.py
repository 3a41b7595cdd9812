"""Read views: flattened nodes, metadata, overview, search, debug, client-side graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.ids import contains_text, first_text, has_text
from codeloom.operators.lookup import of_project
from codeloom.schema import Graph

OVERVIEW_NODES, OVERVIEW_EDGES, SEARCH_NODES = 320, 1000, 80
_ORDER = ("packages", "units", "functions", "endpoints")
_TYPE = {"packages": "PACKAGE", "units": "UNIT", "functions": "FUNCTION"}


def nodes(graph: Graph) -> DataFrame:
    """All nodes in one shape, with `ord`, the ordinal of their table."""
    parts = []
    for i, name in enumerate(_ORDER):
        df = getattr(graph, name)
        end = name == "endpoints"
        path = first_text(*(F.col(c) for c in ("normalizedPath", "path", "topic", "tableName"))) if end else F.lit(None).cast("string")
        parts.append(df.select(
            "id", F.col("id").alias("elementId"), (F.coalesce("endpointType", F.lit("ENDPOINT")) if end else F.lit(_TYPE[name])).alias("type"), "name", "qualifiedName",
            (F.lit(None).cast("string") if name == "packages" else F.col("projectFilePath")).alias("projectFilePath"), "gitRepoUrl", path.alias("path"),
            (F.col("httpMethod") if end else F.lit(None).cast("string")).alias("httpMethod"), F.lit(None).cast("int").alias("depth"), F.lit(i).alias("ord"),
        ))
    return reduce(DataFrame.unionByName, parts)


def filtered(view: DataFrame, repo: str | None = None, types: list[str] | None = None) -> DataFrame:
    if repo and repo.strip():
        view = view.filter(F.col("gitRepoUrl") == repo)
    return view.filter(F.col("type").isin(list(types))) if types else view


def induced(relationships: DataFrame, chosen: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges with both ends among the chosen ids."""
    ids = chosen.select("id").distinct()
    own = relationships.filter(F.col("relationshipType").isin(list(types))) if types else relationships
    own = own.join(ids.withColumnRenamed("id", "fromNodeId"), "fromNodeId", "left_semi")
    return own.join(ids.withColumnRenamed("id", "toNodeId"), "toNodeId", "left_semi")


def overview(graph: Graph, repo: str | None = None, types: list[str] | None = None, edge_types: list[str] | None = None, limit: int = OVERVIEW_NODES, edge_limit: int = OVERVIEW_EDGES) -> tuple[DataFrame, DataFrame]:
    """The first nodes by table and id, and the first edges among them by id."""
    chosen = filtered(nodes(graph), repo, types).orderBy("ord", "id").limit(limit)
    return chosen, induced(graph.relationships, chosen, edge_types).orderBy("id").limit(edge_limit)


def query(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """The read endpoint for query text answers with the default overview."""
    return overview(graph)


def matches(keyword: str) -> Column:
    k = F.lit(keyword)
    return contains_text(F.col("name"), k) | contains_text(F.col("qualifiedName"), k) | contains_text(F.col("path"), k)


def search(graph: Graph, keyword: str, repo: str | None = None, types: list[str] | None = None, limit: int = SEARCH_NODES) -> DataFrame:
    return filtered(nodes(graph).filter(matches(keyword)), repo, types).orderBy("ord", "id").limit(limit)


def debug(graph: Graph, text: str, edge_limit: int = OVERVIEW_EDGES) -> tuple[DataFrame, DataFrame]:
    """Nodes of exactly this name, qualified name or id, and edges among them."""
    hit = [F.coalesce(F.col(c) == text, F.lit(False)) for c in ("name", "qualifiedName", "id")]
    chosen = nodes(graph).filter(hit[0] | hit[1] | hit[2])
    return chosen, induced(graph.relationships, chosen).orderBy("id").limit(edge_limit)


def subgraph(graph: Graph, start: str, text: str | None = None, max_depth: int | None = None, direction: str | None = None, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What a client loads around a node: the traversal from it, the nodes that `text` (default: the id) names, and itself; each node and edge once."""
    from codeloom.operators.traverse import traverse

    reached, walked = traverse(graph.relationships, start, max_depth, direction, types)
    named, among = debug(graph, text or start)
    wanted = reached.select(F.col("node").alias("id")).unionByName(named.select("id")).unionByName(reached.sparkSession.createDataFrame([(start,)], "id string"))
    chosen = nodes(graph).join(wanted.distinct(), "id", "left_semi").dropDuplicates(["id"])
    return chosen, walked.unionByName(among.select(walked.columns)).dropDuplicates(["id"])


def metadata(graph: Graph) -> DataFrame:
    """(kind, value) in order: distinct repositories, node types and relationship types that are not blank."""
    view = nodes(graph)
    parts = [view.select(F.lit("gitRepoUrl").alias("kind"), F.col("gitRepoUrl").alias("value")), view.select(F.lit("nodeType").alias("kind"), F.col("type").alias("value")), graph.relationships.select(F.lit("relationshipType").alias("kind"), F.col("relationshipType").alias("value"))]
    return reduce(DataFrame.unionByName, parts).filter(has_text(F.col("value"))).distinct().orderBy("kind", "value")


def project_counts(graph: Graph, project: str) -> DataFrame:
    """(name, n) for the five tables; empty ones count 0."""
    parts = [of_project(df, project).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in graph.tables().items()]
    return reduce(DataFrame.unionByName, parts)


def edges_by_type(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("relationshipType").agg(F.count("*").alias("n"))


def contract_violations(relationships: DataFrame) -> DataFrame:
    """Types whose edges do not all have the same end labels, with the number of label pairs."""
    pairs = relationships.select("relationshipType", "fromNodeType", "toNodeType").distinct()
    return pairs.groupBy("relationshipType").agg(F.count("*").alias("n")).filter("n > 1")


def with_stubs(node_ids: DataFrame, relationships: DataFrame) -> DataFrame:
    """(id, type) of the nodes and of the ends of edges that are not among them, as CodeElement."""
    ends = relationships.select(F.explode(F.array("fromNodeId", "toNodeId")).alias("id")).filter(has_text(F.col("id"))).distinct()
    stubs = ends.join(node_ids.select("id"), "id", "left_anti").select("id", F.lit("CodeElement").alias("type"))
    return node_ids.select("id", "type").unionByName(stubs)


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Two node tables as one: fields of the new row overlay those of the old."""
    n = new.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in new.columns if c != key))
    both = old.join(n, key, "full_outer")
    return both.select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns if c != key))
