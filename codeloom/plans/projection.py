"""Projection of order and event tables into the graph schema, for checks at any scale.

Regions and nations become packages, customers and suppliers units, orders and parts
functions, line items calls, pages and events endpoint sites. Ids are scoped to PROJECT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import ids
from codeloom.schema import ENDPOINT, FUNCTION, PACKAGE, RELATIONSHIP, UNIT, Graph, conform

PROJECT = "tpch"
P = F.lit
#: Rows of a table that a task of a join takes, however large the table is.
TASK_ROWS = 2**19


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scoped(c: Column) -> Column:
    return F.concat(F.lit(f"{PROJECT}::"), c)


def _node(df: DataFrame, raw_id: Column, name: Column, qualified: Column, file: Column, **more: Column) -> DataFrame:
    return df.select(
        _scoped(raw_id).alias("id"), name.alias("name"), qualified.alias("qualifiedName"), F.lit("java").alias("language"), F.lit(PROJECT).alias("projectName"),
        file.alias("projectFilePath"), F.lit("main").alias("gitBranch"), *(c.alias(k) for k, c in more.items()),
    )


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = _read(spark, sf_dir, "region"), _read(spark, sf_dir, "nation")
    top = region.select(F.col("r_name").alias("q"), F.col("r_name").alias("n"))
    sub = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(".", "r_name", "n_name").alias("q"), F.col("n_name").alias("n"))
    both = top.unionByName(sub)
    out = _node(both, ids.package_id(F.col("q")), F.col("n"), F.col("q"), F.lit(None), packagePath=ids.package_path(F.col("q")))
    return conform(out, PACKAGE)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = _read(spark, sf_dir, "region"), _read(spark, sf_dir, "nation")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", _scoped(ids.package_id(F.concat_ws(".", "r_name", "n_name"))).alias("packageId"), "r_name", "n_name")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _nations(spark, sf_dir)
    c = _read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    s = _read(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    key, supp = _text("c_custkey"), _text("s_suppkey")
    classes = _node(c, F.concat(P("unit:cust.C"), key), F.concat(P("C"), key), F.concat(P("cust.C"), key), F.concat(P("cust/c"), key, P(".java")), unitType=P("class"), packageId=F.col("packageId"), gitRepoUrl=F.concat(P("git@example/"), F.col("c_mktsegment"), P(".git")))
    faces = _node(s, F.concat(P("unit:supp.S"), supp), F.concat(P("S"), supp), F.concat(P("supp.S"), supp), F.concat(P("supp/s"), supp, P(".java")), unitType=P("interface"), packageId=F.col("packageId"), gitRepoUrl=F.lit(None).cast("string"))
    return conform(classes.unionByName(faces), UNIT)


def order_function(cust: Column, order: Column) -> Column:
    return F.concat(P("fn:cust.C"), cust.cast("string"), P(".order"), order.cast("string"), P("()"))


def part_function(part: Column) -> Column:
    return F.concat(P("fn:part.P"), part.cast("string"), P(".use()"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, part = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "part")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = orders.select("o_orderkey", "o_custkey").withColumn("n", n)
    name = F.concat(P("order"), _text("o_orderkey"))
    qualified = F.substring(order_function(F.col("o_custkey"), F.col("o_orderkey")), P(4), P(200))
    real = _node(o, order_function(F.col("o_custkey"), F.col("o_orderkey")), name, qualified, F.concat(P("cust/c"), _text("o_custkey"), P(".java")), signature=F.concat(name, P("()")), isPlaceholder=P(False), startLine=(F.col("n") - 1) * 10 + 1, endLine=F.col("n") * 10, gitRepoUrl=P("git@example/orders.git"))
    q = F.concat(P("part.P"), _text("p_partkey"), P(".use()"))
    parts = _node(part, part_function(F.col("p_partkey")), P("use"), q, F.concat(P("part/p"), _text("p_partkey"), P(".java")), signature=P("use()"), isPlaceholder=F.col("p_size") >= 40, startLine=F.lit(None).cast("int"), endLine=F.lit(None).cast("int"), gitRepoUrl=P("git@example/parts.git"))
    return conform(real.unionByName(parts), FUNCTION)


def endpoint_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint rows before deduplication, with pos: one for each page and event."""
    side = lambda c: F.when(F.col(c) % 2 == 0, "inbound").otherwise("outbound")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[?#].*$", ""), r"/[0-9]+", "/{param}")
    web = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), side("page_id").alias("direction"), path.alias("path"))
    web = web.withColumns({"endpointType": P("HTTP"), "httpMethod": P("GET"), "matchIdentity": F.concat(P("HTTP:GET:"), F.col("path")), "topic": F.lit(None).cast("string"), "projectFilePath": F.lit(None).cast("string"), "startLine": F.lit(None).cast("int")})
    mq = _read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), side("user_id").alias("direction"), F.col("event_type").alias("topic"), F.concat(P("cust/c"), _text("user_id"), P(".java")).alias("projectFilePath"), (F.col("event_id") % 100 + 1).cast("int").alias("startLine"))
    mq = mq.withColumns({"endpointType": P("MQ"), "httpMethod": F.lit(None).cast("string"), "path": F.lit(None).cast("string"), "matchIdentity": F.concat(P("MQ:"), F.col("topic"))})
    both = web.unionByName(mq)
    both = both.withColumns({
        "id": _scoped(ids.endpoint_id(F.col("direction"), F.col("endpointType"), F.col("matchIdentity"))), "projectName": P(PROJECT), "language": P("java"),
        "isExternal": ids.is_external(F.col("direction")), "normalizedPath": F.col("path"), "name": F.coalesce("path", "topic"), "qualifiedName": F.col("matchIdentity"),
    })
    return conform(both, ENDPOINT, "pos")


def edge(df: DataFrame, a: Column, kind: str, b: Column, line: Column | None = None, **more: Column) -> DataFrame:
    """Edges by raw ends: hashed on raw ids, then scoped."""
    return df.select(
        _scoped(ids.relationship_id(a, P(kind), b)).alias("id"), _scoped(a).alias("fromNodeId"), _scoped(b).alias("toNodeId"), P(kind).alias("relationshipType"),
        (F.lit(None) if line is None else line).cast("int").alias("lineNumber"), P("java").alias("language"), P(PROJECT).alias("projectName"), *(c.alias(k) for k, c in more.items()),
    )


def _tasks(df: DataFrame) -> int:
    """Tasks for a stored table's rows; adaptive ones are told by compressed bytes, which are millions of rows as narrow as keys."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their orders' customers, hashed by order."""
    l, o = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    n = _tasks(l)
    l = l.select("l_orderkey", "l_partkey", "l_linenumber").repartition(n, "l_orderkey")
    return l.join(o.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct suppliers and parts of line items; dealt before they are reduced, since pairs repeat too seldom for a partial reduction of a split."""
    l = _read(spark, sf_dir, "lineitem")
    return l.select("l_suppkey", "l_partkey").repartition(_tasks(l), "l_suppkey", "l_partkey").distinct()


def _call(lines: DataFrame, *extra: str) -> DataFrame:
    out = edge(lines, order_function(F.col("o_custkey"), F.col("o_orderkey")), "CALLS", part_function(F.col("l_partkey")), F.col("l_linenumber"), relationshipKind=P("CALL"), callType=P("direct"), **{c: F.col("l_linenumber") for c in extra})
    return conform(out, RELATIONSHIP, *extra)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw calls with repeats, and pos."""
    return _call(_lines(spark, sf_dir), "pos")


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _nations(spark, sf_dir)
    pkg = edge(nations, ids.package_id(F.col("r_name")), "PACKAGE_TO_PACKAGE", ids.package_id(F.concat_ws(".", "r_name", "n_name")))
    u = units(spark, sf_dir).select(ids.raw(P(PROJECT), F.col("packageId")).alias("p"), ids.raw(P(PROJECT), F.col("id")).alias("u"))
    orders = _read(spark, sf_dir, "orders")
    fn = edge(orders, F.concat(P("unit:cust.C"), _text("o_custkey")), "UNIT_TO_FUNCTION", order_function(F.col("o_custkey"), F.col("o_orderkey")))
    contains = pkg.unionByName(edge(u, F.col("p"), "PACKAGE_TO_UNIT", F.col("u"))).unionByName(fn)
    sup = _pairs(spark, sf_dir)
    sup = edge(sup, F.concat(P("unit:supp.S"), _text("l_suppkey")), "TPCH_SUPPLIES", part_function(F.col("l_partkey")), relationshipKind=P("OTHER"), fromNodeType=P("CodeUnit"), toNodeType=P("CodeFunction"))
    return conform(contains, RELATIONSHIP).unionByName(conform(sup, RELATIONSHIP))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.operators.dedupe import first_by_id

    return first_by_id(endpoint_sites(spark, sf_dir)).drop("pos")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure edges and each call once, at its first line; calls are reduced by their keys before ids are built."""
    first = _lines(spark, sf_dir).groupBy("o_custkey", "o_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    return structure(spark, sf_dir).unionByName(_call(first))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    args = (spark, sf_dir)
    return Graph(packages(*args), units(*args), functions(*args), endpoints(*args), relationships(*args))
