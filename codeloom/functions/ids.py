"""Identifiers, endpoint identities and text helpers, all as built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER_SEPARATOR = "::"


def strip(c: Column) -> Column:
    """Both ends without control characters and spaces (all up to U+0020)."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normalize(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def is_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return c.isNull() | ~c.rlike(r"\S")


def has_text(c: Column) -> Column:
    return ~is_blank(c)


def first_text(*cols: Column) -> Column:
    """The first of the columns that is not blank."""
    return F.coalesce(*(F.when(has_text(c), c) for c in cols))


def contains_text(c: Column, keyword: Column) -> Column:
    """Case-insensitive literal containment; null contains nothing."""
    return F.coalesce(F.contains(F.lower(c), F.lower(keyword)), F.lit(False))


def is_scoped(project: Column, ident: Column) -> Column:
    return has_text(project) & F.coalesce(F.startswith(ident, F.concat(project, F.lit("::"))), F.lit(False))


def scoped(project: Column, ident: Column) -> Column:
    """project::ident, unless either is blank or the prefix is there already."""
    return F.when(is_blank(project) | is_blank(ident) | is_scoped(project, ident), ident).otherwise(F.concat(project, F.lit("::"), ident))


def raw(project: Column, ident: Column) -> Column:
    return F.when(is_scoped(project, ident), F.substring(ident, F.length(project) + 3, F.length(ident))).otherwise(ident)


def package_id(name: Column) -> Column:
    return F.concat(F.lit("pkg:"), normalize(name))


def unit_id(name: Column) -> Column:
    return F.concat(F.lit("unit:"), normalize(name))


def function_id(signature: Column) -> Column:
    return F.concat(F.lit("fn:"), normalize(signature))


def placeholder_function_id(signature: Column) -> Column:
    return F.concat(F.lit("placeholder:fn:"), normalize(signature))


def endpoint_id(direction: Column, kind: Column, identity: Column) -> Column:
    return F.concat(F.lit("endpoint:"), normalize(direction), F.lit(":"), normalize(kind), F.lit(":"), F.sha1(normalize(identity)))


def relationship_id(from_id: Column, kind: Column, to_id: Column) -> Column:
    return F.concat(F.lit("rel:"), F.sha1(F.concat_ws("|", normalize(from_id), normalize(kind), normalize(to_id))))


def relationship_type(name: Column) -> Column:
    """Trimmed and upper-cased; null where it is no valid name."""
    t = F.upper(strip(name))
    return F.when(t.rlike(r"^[A-Z][A-Z0-9_]*$"), t)


def http_identity(method: Column, path: Column, normalized_path: Column) -> Column:
    verb = F.when(is_blank(method), "ANY").otherwise(F.upper(strip(method)))
    return F.concat(F.lit("HTTP:"), verb, F.lit(":"), F.coalesce(path, normalized_path, F.lit("")))


def match_identity(kind: Column) -> Column:
    """Of an endpoint row, by its type."""
    other = lambda prefix, field: F.concat(F.lit(prefix), F.coalesce(F.col(field), F.lit("UNKNOWN")))
    return (
        F.when(kind == "MQ", other("MQ:", "topic"))
        .when(kind == "REDIS", other("REDIS:", "keyPattern"))
        .when(kind == "DB", other("DB:", "tableName"))
        .otherwise(http_identity(F.col("httpMethod"), F.col("path"), F.col("normalizedPath")))
    )


def redis_command(c: Column) -> Column:
    u = F.upper(strip(c))
    return F.when(u == "DEL", "DELETE").otherwise(u)


def endpoint_kind(kind: Column) -> Column:
    """Discriminator of a delta's endpoint by its type: mq, redis, db, else http."""
    u = F.upper(normalize(kind))
    return F.when(u.isin("MQ", "REDIS", "DB"), F.lower(u)).otherwise("http")


def is_external(direction: Column) -> Column:
    return F.coalesce(F.lower(direction) == "outbound", F.lit(False))


def display_name(ident: Column) -> Column:
    """A placeholder's qualified name: its id without project and kind prefixes."""
    return F.regexp_replace(F.regexp_replace(ident, r"^.*?::", ""), r"^fn:", "")


def signature_of(qualified: Column) -> Column:
    """What follows the last dot before the first parenthesis."""
    return F.regexp_extract(qualified, r"^(?:[^(]*\.)?([^.(]*(?:\(.*)?)$", 1)


def method_name(qualified: Column) -> Column:
    return F.regexp_extract(signature_of(qualified), r"^([^(]*)", 1)


#: Source languages by file suffix.
LANGUAGES = (("java", (".java",)), ("go", (".go",)), ("python", (".py",)), ("php", (".php",)), ("kotlin", (".kt", ".kts")), ("javascript", (".js", ".jsx")), ("typescript", (".ts", ".tsx")))


def language_of(path: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    cases = [(name, reduce(lambda a, b: a | b, [F.endswith(low, F.lit(s)) for s in suffixes])) for name, suffixes in LANGUAGES]
    return reduce(lambda c, x: c.when(x[1], x[0]), cases[1:], F.when(cases[0][1], cases[0][0])).otherwise("java")


def package_path(qualified: Column) -> Column:
    return F.translate(qualified, ".", "/")


def parent_directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def project_root(absolute: Column, relative: Column) -> Column:
    """What remains of an absolute path before a relative one; null if it does not end so."""
    a, r = F.translate(absolute, "\\", "/"), F.translate(relative, "\\", "/")
    return F.when(F.endswith(a, r), F.regexp_replace(F.substring(a, F.lit(1), F.length(a) - F.length(r)), "/$", ""))


def project_file_path(option: Column, root: Column, path: Column) -> Column:
    """A file's path in its project: as given, else without the project's root."""
    p, r = F.translate(path, "\\", "/"), F.regexp_replace(F.translate(root, "\\", "/"), "/+$", "")
    inside = F.substring(p, F.length(r) + 2, F.length(p))
    return F.coalesce(F.when(has_text(option), option), F.when(has_text(root) & F.startswith(p, F.concat(r, F.lit("/"))), inside), p)


def repo_display_name(url: Column) -> Column:
    """Last two parts of a repository's address, without .git."""
    parts = F.filter(F.split(F.regexp_replace(url, r"\.git$", ""), "[/:]"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")
