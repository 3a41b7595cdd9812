"""Graph deltas as JSON: reading, unwrapping and filling in what producers leave out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.ids import endpoint_kind, first_text, has_text
from codeloom.schema import DELTA, TABLES, Graph, conform

IMPORTED = "imported-graph"
_RAW = T.StructType([*DELTA.fields, T.StructField("projectName", T.StringType()), T.StructField("name", T.StringType()), T.StructField("graph", DELTA)])
_NODES = ("packages", "units", "functions", "endpoints")


def read(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row for each delta file, with the fields of DELTA and an inferred scope."""
    raw = spark.read.schema(_RAW).option("multiLine", multi_line).json(path)
    return with_scope(raw.withColumn("delta_id", F.input_file_name()))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, has_text), 0)


def with_scope(raw: DataFrame) -> DataFrame:
    """Unwraps `graph` and infers the project, the language and the source files.

    Project: given, else the first node's project name, else the part of the first scoped
    id before '#', else imported-graph. Language: the first that a node has, else unknown.
    """
    wrapped = F.col("graph").isNotNull()
    body = [F.when(wrapped, F.col(f"graph.{f.name}")).otherwise(F.col(f.name)).alias(f.name) for f in DELTA.fields]
    rest = [c for c in ("delta_id", "projectName", "name") if c in raw.columns]
    d = raw.select(*body, *rest)
    d = d.withColumns({t: F.coalesce(t, F.array().cast(DELTA[t].dataType)) for t in (*_NODES, "relationships")})
    field = lambda table, name: F.transform(F.col(table), lambda x: x[name])
    names = F.concat(*(field(t, "projectName") for t in _NODES))
    marked = F.concat(*(field(t, "id") for t in ("units", "packages", "functions", "endpoints")))
    prefix = F.substring_index(_first(F.filter(marked, lambda x: F.contains(x, F.lit("#")))), "#", 1)
    project = first_text(F.col("scope.projectName"), F.col("projectName"), F.col("name"), _first(names), prefix, F.lit(IMPORTED))
    language = first_text(F.col("scope.language"), _first(F.concat(*(field(t, "language") for t in ("units", "functions", "endpoints", "packages")))), F.lit("unknown"))
    files = F.array_distinct(F.filter(F.concat(*(field(t, "projectFilePath") for t in ("units", "functions", "endpoints"))), has_text))
    given = F.coalesce(F.col("scope.sourceFiles"), F.array().cast("array<string>"))
    scope = {f.name: F.col(f"scope.{f.name}") for f in DELTA["scope"].dataType.fields}
    scope |= {"projectName": project, "language": language, "sourceFiles": F.when(F.size(given) > 0, given).otherwise(files), "changeType": first_text(F.col("scope.changeType"), F.lit("SOURCE_MODIFIED"))}
    filled = F.transform("endpoints", lambda e: e.withField("endpointKind", first_text(e["endpointKind"], endpoint_kind(e["endpointType"]))))
    return d.withColumn("scope", F.struct(*(c.alias(k) for k, c in scope.items()))).withColumn("endpoints", filled).drop("projectName", "name")


def tables(deltas: DataFrame) -> Graph:
    """The deltas' rows as five tables with pos, their place in the delta; blank projects take the scope's."""
    out = {}
    for name, schema in TABLES.items():
        rows = deltas.select(F.col("scope.projectName").alias("_p"), F.posexplode(name).alias("pos", "row")).select("_p", F.col("pos").cast("long").alias("pos"), "row.*")
        out[name] = conform(rows.withColumn("projectName", first_text(F.col("projectName"), F.col("_p"))), schema, "pos")
    return Graph(**out)


def deleted(deltas: DataFrame, column: str) -> DataFrame:
    return deltas.select(F.explode(column).alias("id"))


def union(parts: list[Graph]) -> Graph:
    """Tables of several producers, one after another."""
    return Graph(**{t: reduce(DataFrame.unionByName, [getattr(p, t) for p in parts]) for t in TABLES})
