"""Endpoints: matching across projects, binding to functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.ids import has_text, relationship_id, scoped


def match_edges(new: DataFrame, stored: DataFrame, project: str) -> DataFrame:
    """MATCHES edges from outbound to inbound endpoints of the same identity, of all projects.

    Pairs are found between the distinct ids of an identity; an endpoint without an
    inbound direction looks for inbound partners and is the source only if it is outbound.
    """
    own = new.filter(has_text(F.col("matchIdentity"))).select(F.col("id").alias("a"), "matchIdentity", F.col("direction").alias("da")).distinct()
    other = stored.select(F.col("id").alias("b"), "matchIdentity", F.col("direction").alias("db")).distinct()
    inbound = F.coalesce(F.col("da") == "inbound", F.lit(False))
    pair = own.join(other, "matchIdentity").filter(F.when(inbound, F.col("db") == "outbound").otherwise(F.col("db") == "inbound"))
    outbound = F.coalesce(F.col("da") == "outbound", F.lit(False))
    ends = pair.select(F.when(outbound, F.col("a")).otherwise(F.col("b")).alias("fromNodeId"), F.when(outbound, F.col("b")).otherwise(F.col("a")).alias("toNodeId")).distinct()
    return ends.select(
        scoped(F.lit(project), relationship_id(F.col("fromNodeId"), F.lit("MATCHES"), F.col("toNodeId"))).alias("id"), "fromNodeId", "toNodeId", F.lit("MATCHES").alias("relationshipType"),
        F.lit("MATCHES_ENDPOINT").alias("relationshipKind"), F.lit("CodeEndpoint").alias("fromNodeType"), F.lit("CodeEndpoint").alias("toNodeType"), F.lit(project).alias("projectName"),
    )


#: Lines of a bin of the range join.
BIN = 64


def bind_by_line(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(site, function): the first function of the site's file whose lines hold the site's line.

    sites: (site, projectFilePath, startLine). Functions are listed in every bin of BIN
    lines they touch, so the range join is an equi join on file and bin, and a file with
    very many functions is dealt over its bins. First: by start line, then id.
    """
    fn = functions.filter("startLine is not null and endLine >= startLine").select("id", "projectFilePath", F.col("startLine").alias("lo"), F.col("endLine").alias("hi"))
    fn = fn.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor(F.col("hi") / BIN))))
    at = sites.withColumn("bin", F.floor(F.col("startLine") / BIN))
    hit = at.join(fn, ["projectFilePath", "bin"]).filter("startLine between lo and hi")
    return hit.groupBy("site").agg(F.min(F.struct("lo", "id")).alias("f")).select("site", F.col("f.id").alias("function"))


def bind(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """As bind_by_line, but a site's `function` (id or qualified name), where it names one, comes first."""
    named = sites.filter(has_text(F.col("function"))).select("site", F.col("function").alias("wanted"))
    by = functions.select(F.col("id").alias("wanted"), F.col("id")).unionByName(functions.select(F.col("qualifiedName").alias("wanted"), "id"))
    found = named.join(by, "wanted").groupBy("site").agg(F.min("id").alias("function"))
    rest = sites.join(found.select("site"), "site", "left_anti").select("site", "projectFilePath", "startLine")
    return found.unionByName(bind_by_line(rest, functions))


def binding_edges(bound: DataFrame, endpoints: DataFrame, project: str) -> DataFrame:
    """Inbound endpoints point to their function, functions to outbound endpoints."""
    e = endpoints.select(F.col("id").alias("site"), "direction").join(bound, "site").filter(F.col("direction").isin("inbound", "outbound"))
    inbound = F.col("direction") == "inbound"
    out = e.select(F.when(inbound, F.col("site")).otherwise(F.col("function")).alias("fromNodeId"), F.when(inbound, F.col("function")).otherwise(F.col("site")).alias("toNodeId"), F.when(inbound, "ENDPOINT_TO_FUNCTION").otherwise("FUNCTION_TO_ENDPOINT").alias("relationshipType"))
    return out.withColumn("id", scoped(F.lit(project), relationship_id(F.col("fromNodeId"), F.col("relationshipType"), F.col("toNodeId"))))
