"""Applying graph deltas: scoping, deduplication, validation, merge plans, change feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.ids import is_blank, scoped
from codeloom.operators import dedupe, matching, store
from codeloom.operators.keys import FEW, possible, repeated, within, without
from codeloom.operators.lookup import EDGE_KEY, of_project
from codeloom.operators.traverse import stored, written
from codeloom.schema import ENDPOINT, NODE_TYPES, RELATIONSHIP, TABLES, Graph, conform, with_defaults

_KIND = {"packages": "package", "units": "unit", "functions": "function", "endpoints": "endpoint"}


class Invalid(ValueError):
    """A delta with errors; the message names at most five."""

    def __init__(self, errors: DataFrame):
        rows = errors.orderBy("code", "message").limit(6).collect()
        super().__init__("; ".join(f"{r['code']}: {r['message']}" for r in rows[:5]) + (" ..." if len(rows) > 5 else ""))
        self.errors = errors


def rescoped(delta: Graph, project: str) -> Graph:
    """The delta's rows under the project: projectName overwritten, ids and references prefixed."""
    p = F.lit(project)
    out = {}
    for name, df in delta.tables().items():
        refs = [c for c in ("id", "packageId", "fromNodeId", "toNodeId") if c in df.columns]
        out[name] = df.withColumns({c: scoped(p, F.col(c)) for c in refs} | {"projectName": p})
    return Graph(**out)


def diagnostics(delta: Graph, deleted_nodes: DataFrame | None = None, deleted_edges: DataFrame | None = None, deduplicated: bool = False) -> DataFrame:
    """(code, message, projectFilePath, lineNumber): one row for each error of a delta with `pos` in its tables.

    deduplicated: its edges come from dedupe.edges, which leaves no id twice. Repeats are told by aggregates over ids and keys, types by one map of ids to the
    first table that uses them. Codes and messages are fixed values that callers match.
    """
    parts: list[DataFrame] = []
    where = lambda df: F.col("projectFilePath") if "projectFilePath" in df.columns else F.lit(None).cast("string")
    at = lambda df: F.col(next((c for c in ("startLine", "lineNumber") if c in df.columns), "")) if {"startLine", "lineNumber"} & set(df.columns) else F.lit(None).cast("int")

    def report(df: DataFrame, bad: Column, code: str, text: Column) -> None:
        parts.append(df.filter(bad).select(F.lit(code).alias("code"), text.alias("message"), where(df).alias("projectFilePath"), at(df).alias("lineNumber")))

    types = reduce(DataFrame.unionByName, [getattr(delta, t).select("id", F.lit(NODE_TYPES[t]).alias("type"), F.lit(i).alias("ord")) for i, t in enumerate(NODE_TYPES)]).filter(~is_blank(F.col("id")))
    # Tables that use an id, by the id's hash; names meet only where these differ.
    used = written(types.groupBy(F.xxhash64("id").alias("_h")).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")))
    n_used, hashed = used.count(), F.xxhash64("id")
    shared = written(used.filter("lo < hi").select("_h"))
    n_shared = shared.count()

    def first(found: DataFrame, n: int) -> DataFrame:
        """(id, type, ord) of the first table for ids whose hash may be among the found ones."""
        return possible(types, hashed, found, n).groupBy("id").agg(F.min_by("type", "ord").alias("type"), F.min("ord").alias("ord"))

    def again(frame: DataFrame, by: str) -> DataFrame | None:
        """Rows whose text in `by` an earlier one has; None if there are surely none."""
        found, n = repeated(frame, F.xxhash64(by))
        if n == 0:
            return None
        return possible(frame, F.xxhash64(by), found, n).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).filter("_n > 1")

    for i, (table, kind) in enumerate(_KIND.items()):
        df = getattr(delta, table)
        report(df, is_blank(F.col("id")), f"{kind}.id.required", F.lit(f"{kind} id must not be blank"))
        named = df.filter(~is_blank(F.col("id")))
        if (later := again(named, "id")) is not None:
            report(later, F.lit(True), f"{kind}.id.duplicate", F.concat(F.lit(f"{kind} id is duplicated in delta: "), F.col("id")))
        if n_shared:
            other = possible(named, hashed, shared, n_shared).join(first(shared, n_shared).filter(F.col("ord") < i), "id")
            report(other, F.lit(True), "node.id.type.conflict", F.concat(F.lit("node id is used by multiple node types: "), F.col("id"), F.lit(" ("), F.col("type"), F.lit(f", {NODE_TYPES[table]})")))
        needed = ["language", "projectName", "projectFilePath"] + (["qualifiedName"] if kind != "endpoint" else [])
        for c in needed:
            report(df, is_blank(F.col(c)), f"{kind}.{c}.required", F.lit(f"{kind} {c} must not be blank"))
    e = delta.endpoints
    report(e, F.col("endpointType").isNull(), "endpoint.type.required", F.lit("endpoint endpointType must not be null"))
    report(e, ~is_blank(F.col("direction")) & ~F.col("direction").isin("inbound", "outbound"), "endpoint.direction.invalid", F.concat(F.lit("endpoint direction must be inbound or outbound: "), F.col("direction")))

    rel = with_defaults(delta.relationships)
    for c, short in (("fromNodeId", "from"), ("toNodeId", "to"), ("id", "id")):
        report(rel, is_blank(F.col(c)), f"relationship.{short}.required", F.lit(f"relationship {c} must not be blank"))
    report(rel, is_blank(F.col("relationshipType")), "relationship.type.required", F.lit("relationship relationshipType must not be null"))
    typed = rel.filter(~is_blank(F.col("relationshipType")))
    for c, short in (("relationshipKind", "kind"), ("fromNodeType", "fromNodeType"), ("toNodeType", "toNodeType")):
        report(typed, is_blank(F.col(c)), f"relationship.{short}.required", F.concat(F.lit(f"language-specific relationship must declare {c}: "), F.col("relationshipType")))
    for c in ("language", "projectName"):
        report(typed, is_blank(F.col(c)), f"relationship.{c}.required", F.lit(f"relationship {c} must not be blank"))
    key = F.concat_ws(":", *(F.coalesce(c, F.lit("null")) for c in EDGE_KEY))
    for name, frame, by in (("id.duplicate", typed.filter(~is_blank(F.col("id"))), F.col("id")), ("duplicate", typed, key)):
        if (deduplicated and name == "id.duplicate") or (later := again(frame.withColumn("_key", by), "_key")) is None:
            continue
        report(later, F.lit(True), f"relationship.{name}", F.concat(F.lit("relationship is duplicated in delta: " if name == "duplicate" else "relationship id is duplicated in delta: "), F.col("_key")))
    for side in ("from", "to"):
        ends = typed.select(F.col(f"{side}NodeId").alias("id"), F.col(f"{side}NodeType").alias("expected")).filter(~is_blank(F.col("expected")))
        told = used.select("_h", *(F.element_at(F.array(*map(F.lit, NODE_TYPES.values())), F.col(c) + 1).alias(c) for c in ("lo", "hi")))
        near = (possible(ends, hashed, used, n_used) if n_used <= FEW else ends).select(hashed.alias("_h"), "expected")
        bad = written(near.join(told, "_h").filter("lo <> expected OR hi <> expected").select("_h").distinct())
        n_bad = bad.count()
        if n_bad == 0:
            continue
        wrong = possible(ends, hashed, bad, n_bad).join(first(bad, n_bad).select("id", "type"), "id").filter("type <> expected")
        report(wrong, F.lit(True), f"relationship.{side}.type.invalid", F.concat(F.lit(f"relationship {side} node type must be "), F.col("expected"), F.lit(" but was "), F.col("type"), F.lit(": "), F.col("id")))
    for name, gone in (("deletedNodeIds", deleted_nodes), ("deletedRelationshipIds", deleted_edges)):
        if gone is not None:
            report(gone, is_blank(F.col("id")), f"{name}.blank", F.lit(f"{name} must not contain blank ids"))
    return reduce(DataFrame.unionByName, parts)


def save_plan(stored: DataFrame, functions: DataFrame) -> DataFrame:
    """functions with `action`: insert if not stored, skip for a placeholder over anything, else update."""
    known = stored.select("id", F.lit(True).alias("_known"))
    placeholder = F.coalesce("isPlaceholder", F.lit(False))
    action = F.when(F.col("_known").isNull(), "insert").when(placeholder, "skip").otherwise("update")
    return functions.join(known.dropDuplicates(["id"]), "id", "left").withColumn("action", action).drop("_known")


def node_actions(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with `action`: update if the id is stored, else insert."""
    known = stored.select("id", F.lit(True).alias("_known")).dropDuplicates(["id"])
    return rows.join(known, "id", "left").withColumn("action", F.when(F.col("_known"), "update").otherwise("insert")).drop("_known")


def missing_edges(stored: DataFrame, rows: DataFrame, project: str) -> DataFrame:
    """Edges whose ends and type the project does not have."""
    return without(rows, (of_project(stored, project), EDGE_KEY))


def split_by_kind(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structure and call edges; supplied matches are discarded, as they are computed."""
    filled = with_defaults(rows)
    kind = F.coalesce("relationshipKind", F.lit(""))
    return filled.filter(~kind.isin("CALL", "MATCHES_ENDPOINT")), filled.filter(kind == "CALL")


def apply(graph: Graph, delta: Graph, project: str, deleted_nodes: DataFrame | None = None, deleted_edges: DataFrame | None = None, validate: bool = True) -> tuple[Graph, DataFrame]:
    """(graph after the delta, node events). The delta's tables carry `pos`, its rows' order.

    Scope, deduplicate, validate; then deletions, packages, units, functions, endpoints
    (only new ones), match edges, missing structure edges, missing calls. The delta's tables
    and new edges are written to the shared folder between steps; the caller commits once.
    """
    d = rescoped(delta, project)
    d = d.with_(endpoints=dedupe.first_by_id(d.endpoints))
    d = Graph(**{name: dedupe.edges(df) if name == "relationships" else written(df) for name, df in d.tables().items()})  # read many times below
    p = F.lit(project)
    gone = deleted_nodes.select(scoped(p, F.col("id")).alias("id")) if deleted_nodes is not None else None
    cut = deleted_edges.select(scoped(p, F.col("id")).alias("id")) if deleted_edges is not None else None
    if validate:
        errors = diagnostics(d, gone, cut, deduplicated=True)
        if not errors.isEmpty():
            raise Invalid(errors)
    events: list[DataFrame] = []
    event = lambda df, op, kind: events.append(df.select(F.lit(op).alias("operation") if isinstance(op, str) else op.alias("operation"), F.lit(kind).alias("nodeType"), F.col("id").alias("nodeId"), p.alias("projectName")))
    if cut is not None:
        graph = graph.with_(relationships=store.delete_edges(graph.relationships, project, cut))
    if gone is not None:
        graph = store.delete_nodes(graph, project, gone)
        event(gone, "DELETE", None)
    # A delta's nodes are few beside the stored ones, of which only these ids are looked at.
    known = {t: written(within(of_project(getattr(graph, t), project).select("id"), getattr(d, t), ["id"])) for t in ("packages", "units", "functions")}
    out = {}
    for table in ("packages", "units"):
        rows = node_actions(known[table], getattr(d, table))
        event(rows, F.upper("action"), NODE_TYPES[table])
        out[table] = store.upsert_edges(getattr(graph, table), conform(rows, TABLES[table], "pos"), "pos")
    plan = save_plan(known["functions"], d.functions).filter("action <> 'skip'")
    event(plan, F.upper("action"), "CodeFunction")
    out["functions"] = store.upsert_edges(graph.functions, conform(plan, TABLES["functions"], "pos"), "pos")
    fresh = d.endpoints.join(of_project(graph.endpoints, project).select("id"), "id", "left_anti")
    event(fresh, "INSERT", "CodeEndpoint")
    out["endpoints"] = store.upsert(graph.endpoints, conform(fresh, ENDPOINT, "pos"), "pos")
    match = conform(matching.match_edges(d.endpoints, out["endpoints"], project), RELATIONSHIP)
    edges = graph.relationships if stored(graph.relationships) else written(graph.relationships)
    # Steps add the rows that they write; the edges before them are read, not written again.
    fresh = written(match)
    edges = edges if fresh.isEmpty() else store.upsert_edges(edges, fresh)
    for part in split_by_kind(d.relationships):
        if not part.isEmpty():
            fresh = missing_edges(edges, part, project)
            # All of them are missing: they are rows of the delta, which is written.
            fresh = conform(fresh, RELATIONSHIP) if fresh is part else written(conform(fresh, RELATIONSHIP))
            edges = store.upsert_edges(edges, fresh)
    return graph.with_(**out, relationships=edges), reduce(DataFrame.unionByName, events)
