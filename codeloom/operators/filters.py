"""Filters of calls by their target, as column predicates that one filter() combines.

Columns: name, args (parameter types), returnType, body and last_parameter of a scanned
method, and the qualified name of the type that declares it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _returns(kind: Column, *names: str) -> Column:
    return F.coalesce(kind, F.lit("void")).isin(*names)


def getter(name: Column, args: Column, return_type: Column) -> Column:
    """getX without arguments and with a result, or isX without arguments and with a boolean one."""
    get = name.rlike(r"^get\p{Lu}") & ~_returns(return_type, "void")
    test = name.rlike(r"^is\p{Lu}") & _returns(return_type, "boolean", "Boolean", "java.lang.Boolean")
    return (get | test) & (F.size(args) == 0)


def setter(name: Column, args: Column, return_type: Column) -> Column:
    """setX with one argument and no result."""
    return name.rlike(r"^set\p{Lu}") & (F.size(args) == 1) & _returns(return_type, "void")


def accessor(name: Column, args: Column, return_type: Column) -> Column:
    """Whether a method is a bean's getter or setter by its declaration; such targets are filtered out."""
    return getter(name, args, return_type) | setter(name, args, return_type)


def trivial_accessor(name: Column, args: Column, return_type: Column, body: Column, parameter: Column) -> Column:
    """Whether a getter only returns a field, or a setter only puts its parameter into one; null bodies are not."""
    reads = body.rlike(r"^return\s+(?:this(?:\.\w+)+|(?!(?:null|true|false|this)\b)[A-Za-z_$]\w*)\s*;$")
    left, right = (F.regexp_extract(body, r"^((?:this(?:\.\w+)+)|[A-Za-z_$]\w*)\s*=\s*(\w+)\s*;$", i) for i in (1, 2))
    writes = (right == parameter) & (right != "") & (left != parameter)
    return F.coalesce((getter(name, args, return_type) & reads) | (setter(name, args, return_type) & writes), F.lit(False))


def from_source_or_listed(from_source: Column, declaring: Column, prefixes: list[str]) -> Column:
    """Whether a call's target is in the scanned sources or its type's qualified name begins with a listed prefix; null types are not."""
    listed = reduce(lambda a, b: a | b, [F.startswith(declaring, F.lit(p)) for p in prefixes], F.lit(False))
    return F.coalesce(declaring.isNotNull() & (from_source | listed), F.lit(False))


def pipeline(rows: DataFrame, *keep: Column) -> DataFrame:
    """The rows that every predicate keeps; without predicates all."""
    return rows.filter(reduce(lambda a, b: a & b, keep, F.lit(True)))
