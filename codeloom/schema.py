"""Schemas of the five graph tables, deltas and events; the declared relationship types."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_NODE = {c: S for c in ("id", "name", "qualifiedName", "language", "projectName", "projectFilePath", "gitRepoUrl", "gitBranch")}
_LINES = {"startLine": I, "endLine": I}

PACKAGE = _struct(**_NODE, packagePath=S)
UNIT = _struct(**_NODE, **_LINES, unitType=S, modifiers=T.ArrayType(S), isAbstract=B, packageId=S)
FUNCTION = _struct(**_NODE, **_LINES, signature=S, returnType=S, modifiers=T.ArrayType(S), isStatic=B, isAsync=B, isConstructor=B, isPlaceholder=B)
ENDPOINT = _struct(
    **_NODE, **_LINES, endpointType=S, direction=S, isExternal=B,
    **{c: S for c in "httpMethod path normalizedPath topic group operation brokerType keyPattern command dataStructure tableName dbOperation serviceName parseLevel targetService matchIdentity other".split()},
)
RELATIONSHIP = _struct(id=S, fromNodeId=S, toNodeId=S, relationshipType=S, relationshipKind=S, fromNodeType=S, toNodeType=S, lineNumber=I, callType=S, language=S, projectName=S)
DIAGNOSTIC = _struct(level=S, code=S, message=S, projectFilePath=S, lineNumber=I, details=T.MapType(S, S))
SCOPE = _struct(projectName=S, language=S, gitRepoUrl=S, gitBranch=S, projectRoot=S, sourceFiles=T.ArrayType(S), changeType=S, attributes=T.MapType(S, S))
DELTA_ENDPOINT = T.StructType([*ENDPOINT.fields, T.StructField("endpointKind", S)])
DELTA = _struct(
    scope=SCOPE, packages=T.ArrayType(PACKAGE), units=T.ArrayType(UNIT), functions=T.ArrayType(FUNCTION), endpoints=T.ArrayType(DELTA_ENDPOINT),
    relationships=T.ArrayType(RELATIONSHIP), deletedNodeIds=T.ArrayType(S), deletedRelationshipIds=T.ArrayType(S), diagnostics=T.ArrayType(DIAGNOSTIC),
)
EVENT = _struct(
    eventId=S, projectName=S, absoluteFilePath=S, gitRepoUrl=S, gitBranch=S, oldFileIdentifier=S, newProjectFilePath=S, changeType=S, language=S, reason=S,
    classpathEntries=T.ArrayType(S), sourcepathEntries=T.ArrayType(S), timestamp=T.TimestampNTZType(),
)

TABLES = {"packages": PACKAGE, "units": UNIT, "functions": FUNCTION, "endpoints": ENDPOINT, "relationships": RELATIONSHIP}
NODE_TYPES = {"packages": "CodePackage", "units": "CodeUnit", "functions": "CodeFunction", "endpoints": "CodeEndpoint"}
ENDPOINT_TYPES = ("HTTP", "MQ", "REDIS", "DB", "UNKNOWN")

#: Declared relationship types with their kind and the labels of their ends.
RELATIONSHIP_TYPES = (
    ("CALLS", "CALL", "CodeFunction", "CodeFunction"),
    ("RENDERS", "RENDERS", "CodeFunction", "CodeFunction"),
    ("PACKAGE_TO_UNIT", "CONTAINS", "CodePackage", "CodeUnit"),
    ("PACKAGE_TO_PACKAGE", "CONTAINS", "CodePackage", "CodePackage"),
    ("UNIT_TO_FUNCTION", "CONTAINS", "CodeUnit", "CodeFunction"),
    ("ENDPOINT_TO_FUNCTION", "BINDS_ENDPOINT", "CodeEndpoint", "CodeFunction"),
    ("FUNCTION_TO_ENDPOINT", "BINDS_ENDPOINT", "CodeFunction", "CodeEndpoint"),
    ("MATCHES", "MATCHES_ENDPOINT", "CodeEndpoint", "CodeEndpoint"),
)


def _declared(of: Column, at: int) -> Column:
    pairs = [F.lit(x) for row in RELATIONSHIP_TYPES for x in (row[0], row[at])]
    return F.element_at(F.create_map(*pairs), of)


def with_defaults(relationships: DataFrame) -> DataFrame:
    """Blank kinds and end labels take what their declared type says; the vocabulary stays open."""
    from codeloom.functions.ids import first_text

    t = F.col("relationshipType")
    return relationships.withColumns({
        "relationshipKind": first_text(F.col("relationshipKind"), _declared(t, 1)),
        "fromNodeType": first_text(F.col("fromNodeType"), _declared(t, 2)),
        "toNodeType": first_text(F.col("toNodeType"), _declared(t, 3)),
    })


def conform(df: DataFrame, schema: T.StructType, *extra: str) -> DataFrame:
    """df with exactly the schema's columns (missing ones null), and `extra` ones after them."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*cols, *extra)


@dataclass(frozen=True)
class Graph:
    """Five tables of one or many projects."""

    packages: DataFrame
    units: DataFrame
    functions: DataFrame
    endpoints: DataFrame
    relationships: DataFrame

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(**{name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})
