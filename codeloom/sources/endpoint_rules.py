"""Endpoints by declarative rules over source text, with the identity's normalisers.

A rule is a row: what to look for (a regular expression with groups), which side and
type of endpoint it makes, and which group is the method or topic and which the path.
Rules and sources are joined by one pass of built-in functions; config placeholders
(${key} or ${key:default}) take the values of a configuration scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import ids
from codeloom.schema import ENDPOINT, conform


@dataclass(frozen=True)
class Rule:
    """pattern groups: value is the path, topic, key or table; method names the verb (0: `verb` as it stands)."""

    name: str
    endpoint_type: str
    direction: str
    pattern: str
    value: int = 1
    method: int = 0
    verb: str | None = None


def slash(path: Column) -> Column:
    """One leading slash, no repeated ones."""
    return F.regexp_replace(F.concat(F.lit("/"), path), r"(?<!:)/{2,}", "/")


def path_variable(path: Column) -> Column:
    """Variables in braces as {param}; a query stays."""
    return F.regexp_replace(path, r"\{[^}/]*\}", "{param}")


def extract_path(url: Column) -> Column:
    """An address without scheme, host and query."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), r"[?#].*$", "")


def placeholder_key(text: Column) -> Column:
    return F.regexp_extract(text, r"\$\{([^:}]+)", 1)


def placeholder_default(text: Column) -> Column:
    return F.regexp_extract(text, r"\$\{[^:}]+:([^}]*)\}", 1)


def extract(sources: DataFrame, rules: list[Rule], config: DataFrame | None = None) -> DataFrame:
    """Endpoint rows with pos from (file, raw, projectName); HTTP matches without a path give none."""
    parts = []
    for i, r in enumerate(rules):
        get = lambda g: F.regexp_extract_all("raw", F.lit(r.pattern), F.lit(g))  # noqa: B023, E731
        verbs = get(r.method) if r.method else F.transform(get(0), lambda _: F.lit(r.verb).cast("string"))  # noqa: B023
        found = sources.select("file", "projectName", F.posexplode(F.arrays_zip(get(r.value).alias("value"), verbs.alias("verb"))).alias("n", "m"))
        parts.append(found.select("file", "projectName", F.lit(r.endpoint_type).alias("endpointType"), F.lit(r.direction).alias("direction"), F.lit(i).alias("rule"), "n", "m.value", "m.verb"))
    rows = reduce(DataFrame.unionByName, parts)
    key = placeholder_key(F.col("value"))
    if config is not None:
        rows = rows.withColumn("key", key).join(config.select("key", F.get("values", F.lit(0)).alias("known")), "key", "left").drop("key")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("string"))
    filled = F.when(key != "", F.concat(ids.first_text(F.col("known"), placeholder_default(F.col("value")), F.lit("")), F.regexp_replace("value", r"^.*?\$\{[^}]*\}", ""))).otherwise(F.col("value"))
    http = F.col("endpointType") == "HTTP"
    path = F.when(http & ids.has_text(filled), slash(path_variable(F.when(F.col("direction") == "outbound", extract_path(filled)).otherwise(filled))))
    rows = rows.withColumns({
        "path": path, "normalizedPath": path, "httpMethod": F.when(http, F.when(ids.is_blank(F.col("verb")), "ANY").otherwise(F.upper("verb"))), "topic": F.when(F.col("endpointType") == "MQ", filled), "keyPattern": F.when(F.col("endpointType") == "REDIS", filled),
        "command": F.when(F.col("endpointType") == "REDIS", ids.redis_command(F.col("verb"))), "tableName": F.when(F.col("endpointType") == "DB", filled), "isExternal": ids.is_external(F.col("direction")), "parseLevel": F.when(F.col("known").isNotNull(), "config").otherwise("full"),
        "projectFilePath": F.col("file"), "language": ids.language_of(F.col("file")), "pos": F.xxhash64("file", "rule", "n"),
    })
    rows = rows.filter(~http | F.col("path").isNotNull()).withColumn("matchIdentity", ids.match_identity(F.col("endpointType")))
    rows = rows.withColumns({"id": ids.endpoint_id(F.col("direction"), F.col("endpointType"), F.col("matchIdentity")), "name": F.coalesce("path", "topic", "keyPattern", "tableName"), "qualifiedName": F.col("matchIdentity")})
    return conform(rows, ENDPOINT, "pos")


def with_fields(endpoints: DataFrame, fields: str = "fields") -> DataFrame:
    """Endpoint rows whose text and boolean columns take the values of a map column; other names in it are ignored."""
    given = F.col(fields)
    known = [f for f in ENDPOINT.fields if f.dataType.simpleString() in ("string", "boolean")]
    value = lambda f: F.coalesce(F.element_at(given, f.name).cast(f.dataType), F.col(f.name) if f.name in endpoints.columns else F.lit(None).cast(f.dataType))
    return endpoints.withColumns({f.name: value(f) for f in known}).drop(fields)
