"""Registered queries over the projected graph, each with the SQL of its result.

All of them read whole tables. Lookups that the interface offers for one file or node
are answered here for all files or nodes at once, which is one join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import ids
from codeloom.operators import changes, dedupe, delta, lookup, matching, store, traverse, view
from codeloom.plans import projection as pr
from codeloom.schema import RELATIONSHIP, conform, with_defaults
from codeloom.streaming import events as ev

P = pr.PROJECT
START = "tpch::unit:cust.C1"
WORD = "c1"

BASE = """
np AS (SELECT n_nationkey, 'tpch::pkg:' || r_name || '.' || n_name AS pid, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
pk AS (SELECT 'tpch::pkg:' || r_name AS id, r_name AS name, r_name AS qualifiedName FROM region UNION ALL SELECT pid, n_name, r_name || '.' || n_name FROM np),
un AS (SELECT 'tpch::unit:cust.C' || c_custkey AS id, 'C' || c_custkey AS name, 'cust.C' || c_custkey AS qualifiedName, 'cust/c' || c_custkey || '.java' AS file, 'git@example/' || c_mktsegment || '.git' AS repo, pid FROM customer JOIN np ON c_nationkey = n_nationkey
  UNION ALL SELECT 'tpch::unit:supp.S' || s_suppkey, 'S' || s_suppkey, 'supp.S' || s_suppkey, 'supp/s' || s_suppkey || '.java', NULL, pid FROM supplier JOIN np ON s_nationkey = n_nationkey),
fn AS (SELECT 'tpch::fn:cust.C' || o_custkey || '.order' || o_orderkey || '()' AS id, 'order' || o_orderkey AS name, 'cust.C' || o_custkey || '.order' || o_orderkey || '()' AS qualifiedName, 'cust/c' || o_custkey || '.java' AS file, 'git@example/orders.git' AS repo,
    false AS ph, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 10 + 1 AS lo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 10 AS hi FROM orders
  UNION ALL SELECT 'tpch::fn:part.P' || p_partkey || '.use()', 'use', 'part.P' || p_partkey || '.use()', 'part/p' || p_partkey || '.java', 'git@example/parts.git', p_size >= 40, NULL, NULL FROM part),
si AS (SELECT 'tpch::endpoint:' || direction || ':' || type || ':' || sha1(identity) AS id, * FROM (
    SELECT CASE WHEN page_id % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS direction, 'HTTP' AS type, 'HTTP:GET:' || path AS identity, path, CAST(NULL AS VARCHAR) AS topic, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INT) AS line, page_id AS pos
    FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/[0-9]+', '/{param}', 'g') AS path FROM pages)
    UNION ALL SELECT CASE WHEN user_id % 2 = 0 THEN 'inbound' ELSE 'outbound' END, 'MQ', 'MQ:' || event_type, NULL, event_type, 'cust/c' || user_id || '.java', event_id % 100 + 1, event_id FROM events)),
ep AS (SELECT id, any_value(direction) AS direction, any_value(type) AS type, any_value(identity) AS identity, any_value(path) AS path, any_value(topic) AS topic, arg_min(coalesce(file, ''), pos) AS file, min(pos) AS pos FROM si GROUP BY id),
ca AS (SELECT 'tpch::fn:cust.C' || o_custkey || '.order' || o_orderkey || '()' AS f, 'tpch::fn:part.P' || l_partkey || '.use()' AS t, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e0 AS (SELECT 'tpch::pkg:' || r_name AS f, 'PACKAGE_TO_PACKAGE' AS ty, pid AS t, CAST(NULL AS INT) AS line, 'CONTAINS' AS kind, 'CodePackage' AS ft, 'CodePackage' AS tt FROM np
  UNION ALL SELECT pid, 'PACKAGE_TO_UNIT', id, CAST(NULL AS INT), 'CONTAINS', 'CodePackage', 'CodeUnit' FROM un
  UNION ALL SELECT 'tpch::unit:cust.C' || o_custkey, 'UNIT_TO_FUNCTION', 'tpch::fn:cust.C' || o_custkey || '.order' || o_orderkey || '()', CAST(NULL AS INT), 'CONTAINS', 'CodeUnit', 'CodeFunction' FROM orders
  UNION ALL SELECT 'tpch::unit:supp.S' || l_suppkey, 'TPCH_SUPPLIES', 'tpch::fn:part.P' || l_partkey || '.use()', CAST(NULL AS INT), 'OTHER', 'CodeUnit', 'CodeFunction' FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
  UNION ALL SELECT f, 'CALLS', t, min(line), 'CALL', 'CodeFunction', 'CodeFunction' FROM ca GROUP BY f, t),
re AS (SELECT 'tpch::rel:' || sha1(f[7:] || '|' || ty || '|' || t[7:]) AS id, * FROM e0),
vi AS (SELECT id, 'PACKAGE' AS type, name, qualifiedName, NULL AS file, NULL AS repo, NULL AS path, NULL AS method, 0 AS ord FROM pk
  UNION ALL SELECT id, 'UNIT', name, qualifiedName, file, repo, NULL, NULL, 1 FROM un UNION ALL SELECT id, 'FUNCTION', name, qualifiedName, file, repo, NULL, NULL, 2 FROM fn
  UNION ALL SELECT id, type, coalesce(path, topic), identity, nullif(file, ''), NULL, coalesce(path, topic), CASE WHEN type = 'HTTP' THEN 'GET' END, 3 FROM ep)
"""


class Queries:
    def __init__(self):
        self.run: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None, recursive: bool = False, base: bool = True):
        def put(f):
            self.run[name] = f
            if sql:
                body = sql.strip()
                lead = f"WITH {'RECURSIVE ' if recursive else ''}{BASE.strip()}"
                self.sql[name] = f"{lead}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}" if base else body
            return f

        return put


Q = Queries()


def _filled(spark, d):
    return with_defaults(pr.relationships(spark, d))


def _fn_file(t):
    return f"(SELECT DISTINCT a.file AS callee_file, b.file AS f, b.repo FROM re JOIN fn a ON a.id = re.t JOIN fn b ON b.id = re.f WHERE re.kind = 'CALL') {t}"


@Q.add("who_calls_me", f"SELECT DISTINCT callee_file, f AS projectFilePath FROM {_fn_file('x')}")
def who_calls_me(s, d):
    return lookup.calling_files(pr.functions(s, d), _filled(s, d), P)


@Q.add("who_calls_me_meta", f"SELECT callee_file, f AS projectFilePath, repo AS gitRepoUrl, 'main' AS gitBranch FROM {_fn_file('x')}")
def who_calls_me_meta(s, d):
    return lookup.callers_of_files(pr.functions(s, d), _filled(s, d), P)


@Q.add("nodes_in_file", "SELECT file AS projectFilePath, count(*) AS n, min(id) AS first_id FROM (SELECT file, id FROM un UNION ALL SELECT file, id FROM fn UNION ALL SELECT nullif(file, ''), id FROM ep) WHERE file IS NOT NULL GROUP BY file")
def nodes_in_file(s, d):
    own = [lookup.of_project(t, P).select("projectFilePath", "id") for t in (pr.units(s, d), pr.functions(s, d), pr.endpoints(s, d))]
    both = own[0].unionByName(own[1]).unionByName(own[2]).filter("projectFilePath is not null")
    return both.groupBy("projectFilePath").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _wanted(s, d):
    """Names asked for: callees of all line items by qualified name, callers of all orders by id."""
    l, o = s.read.parquet(f"{d}/lineitem.parquet"), s.read.parquet(f"{d}/orders.parquet")
    names = l.select(F.concat(F.lit("part.P"), F.col("l_partkey").cast("string"), F.lit(".use()")).alias("wanted"))
    own = o.select(F.concat(F.lit("tpch::"), pr.order_function(F.col("o_custkey"), F.col("o_orderkey"))).alias("wanted"))
    return names.unionByName(own)


_WANTED = "(SELECT 'part.P' || l_partkey || '.use()' AS w FROM lineitem UNION SELECT 'tpch::fn:cust.C' || o_custkey || '.order' || o_orderkey || '()' FROM orders)"


@Q.add("existing_functions", f"SELECT DISTINCT id FROM fn WHERE id IN {_WANTED} OR qualifiedName IN {_WANTED}")
def existing_functions(s, d):
    return lookup.existing_ids(pr.functions(s, d), P, _wanted(s, d))


@Q.add("functions_by_name", f"SELECT id, name, qualifiedName, file AS projectFilePath, ph AS isPlaceholder FROM fn WHERE id IN {_WANTED} OR qualifiedName IN {_WANTED}")
def functions_by_name(s, d):
    return lookup.by_id_or_name(pr.functions(s, d), P, _wanted(s, d)).select("id", "name", "qualifiedName", "projectFilePath", "isPlaceholder")


@Q.add("existing_endpoints", "SELECT DISTINCT id FROM ep WHERE id IN (SELECT id FROM si)")
def existing_endpoints(s, d):
    return lookup.existing_endpoints(pr.endpoints(s, d), P, pr.endpoint_sites(s, d).select(F.col("id").alias("wanted")))


@Q.add("endpoints_by_direction", "SELECT id, type AS endpointType, identity AS matchIdentity FROM ep WHERE direction = 'outbound'")
def endpoints_by_direction(s, d):
    return lookup.by_direction(pr.endpoints(s, d), P, "outbound").select("id", "endpointType", "matchIdentity")


@Q.add("endpoints_by_identity", "SELECT id, direction, topic FROM ep WHERE identity = 'MQ:purchase'")
def endpoints_by_identity(s, d):
    return lookup.by_identity(pr.endpoints(s, d), "MQ:purchase").select("id", "direction", "topic")


_EDGE = "id, f AS fromNodeId, t AS toNodeId, ty AS relationshipType, CAST(line AS INT) AS lineNumber"
_EDGE_COLS = ["id", "fromNodeId", "toNodeId", "relationshipType", "lineNumber"]


@Q.add("outgoing_edges", f"SELECT {_EDGE} FROM re WHERE f IN (SELECT id FROM un)")
def outgoing_edges(s, d):
    return lookup.outgoing(pr.relationships(s, d), P, pr.units(s, d).select(F.col("id").alias("node"))).select(_EDGE_COLS)


@Q.add("incoming_edges", f"SELECT {_EDGE} FROM re WHERE ty = 'CALLS' AND t IN (SELECT id FROM fn WHERE ph)")
def incoming_edges(s, d):
    nodes = pr.functions(s, d).filter("isPlaceholder").select(F.col("id").alias("node"))
    return lookup.incoming(pr.relationships(s, d), P, nodes, "CALLS").select(_EDGE_COLS)


@Q.add("existing_edge_keys", "SELECT DISTINCT f || ':' || t || ':CALLS' AS edge_key FROM ca")
def existing_edge_keys(s, d):
    return lookup.existing_edge_keys(pr.relationships(s, d), P, pr.calls(s, d))


_VIEW = "id, id AS elementId, type, name, qualifiedName, file AS projectFilePath, repo AS gitRepoUrl, path, method AS httpMethod"
_VIEW_COLS = ["id", "elementId", "type", "name", "qualifiedName", "projectFilePath", "gitRepoUrl", "path", "httpMethod"]


@Q.add("view_nodes", f"SELECT {_VIEW} FROM vi")
def view_nodes(s, d):
    return view.nodes(pr.graph(s, d)).select(_VIEW_COLS)


@Q.add("metadata", "SELECT DISTINCT 'gitRepoUrl' AS kind, repo AS value FROM vi WHERE repo IS NOT NULL UNION SELECT 'nodeType', type FROM vi UNION SELECT 'relationshipType', ty FROM re")
def metadata(s, d):
    return view.metadata(pr.graph(s, d))


@Q.add("project_counts", "SELECT 'packages' AS name, count(*) AS n FROM pk UNION ALL SELECT 'units', count(*) FROM un UNION ALL SELECT 'functions', count(*) FROM fn UNION ALL SELECT 'endpoints', count(*) FROM ep UNION ALL SELECT 'relationships', count(*) FROM re")
def project_counts(s, d):
    return view.project_counts(pr.graph(s, d), P)


@Q.add("edges_by_type", "SELECT ty AS relationshipType, count(*) AS n FROM re GROUP BY ty")
def edges_by_type(s, d):
    return view.edges_by_type(pr.relationships(s, d))


_MIXED = "SELECT ty, ft, tt FROM re UNION SELECT 'CALLS', 'CodeUnit', 'CodeFunction' FROM un"


@Q.add("edge_contract_violations", f"SELECT ty AS relationshipType, count(*) AS n FROM (SELECT DISTINCT ty, ft, tt FROM ({_MIXED})) GROUP BY ty HAVING count(*) > 1")
def edge_contract_violations(s, d):
    wrong = conform(pr.units(s, d).select(F.lit("CALLS").alias("relationshipType"), F.lit("CodeUnit").alias("fromNodeType")), RELATIONSHIP)
    return view.contract_violations(with_defaults(pr.relationships(s, d).unionByName(wrong)))


@Q.add("overview", f"WITH c AS (SELECT id FROM vi ORDER BY ord, id LIMIT {view.OVERVIEW_NODES}) SELECT {_EDGE} FROM re WHERE f IN (SELECT id FROM c) AND t IN (SELECT id FROM c) ORDER BY id LIMIT {view.OVERVIEW_EDGES}")
def overview(s, d):
    return view.overview(pr.graph(s, d))[1].select(_EDGE_COLS)


@Q.add("overview_nodes", f"SELECT {_VIEW} FROM vi ORDER BY ord, vi.id LIMIT {view.OVERVIEW_NODES}")
def overview_nodes(s, d):
    return view.overview(pr.graph(s, d))[0].select(_VIEW_COLS)


@Q.add("search", f"SELECT {_VIEW} FROM vi WHERE contains(lower(name), '{WORD}') OR contains(lower(qualifiedName), '{WORD}') OR contains(lower(path), '{WORD}') ORDER BY ord, vi.id LIMIT {view.SEARCH_NODES}")
def search(s, d):
    return view.search(pr.graph(s, d), WORD).select(_VIEW_COLS)


@Q.add("node_debug", f"WITH c AS (SELECT id FROM vi WHERE name = 'use' OR qualifiedName = 'use' OR id = 'use') SELECT {_VIEW} FROM vi WHERE id IN (SELECT id FROM c)")
def node_debug(s, d):
    return view.debug(pr.graph(s, d), "use")[0].select(_VIEW_COLS)


def walk_sql(way: str) -> str:
    step = {"forward": "SELECT f AS a, t AS b FROM re", "backward": "SELECT t AS a, f AS b FROM re", "both": "SELECT f AS a, t AS b FROM re UNION ALL SELECT t, f FROM re"}[way]
    return f"WITH st AS ({step}), w AS (SELECT '{START_OF[way]}' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN st ON a = node WHERE depth < {DEPTH_OF[way]}), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)"


START_OF = {"forward": START, "backward": "tpch::fn:part.P1.use()", "both": START}
DEPTH_OF = {"forward": 3, "backward": 3, "both": 2}
_KEEP = {"forward": "f IN (SELECT node FROM i)", "backward": "t IN (SELECT node FROM i)", "both": "(f IN (SELECT node FROM i) OR t IN (SELECT node FROM i))"}


def _add_walk(way: str) -> None:
    depth = DEPTH_OF[way]

    @Q.add(f"trace_{way}_nodes", f"{walk_sql(way)} SELECT node AS id, depth FROM m", recursive=True)
    def nodes(s, d):
        return traverse.traverse(pr.relationships(s, d), START_OF[way], depth, way)[0].select(F.col("node").alias("id"), F.col("depth").cast("long").alias("depth"))

    @Q.add(f"trace_{way}_edges", f"{walk_sql(way)}, i AS (SELECT node FROM m WHERE depth < {depth}) SELECT {_EDGE} FROM re WHERE {_KEEP[way]}", recursive=True)
    def edges(s, d):
        return traverse.traverse(pr.relationships(s, d), START_OF[way], depth, way)[1].select(_EDGE_COLS)


for _way in ("forward", "backward", "both"):
    _add_walk(_way)

_TREE = ["PACKAGE_TO_PACKAGE", "PACKAGE_TO_UNIT", "UNIT_TO_FUNCTION"]


@Q.add("bfs_rank", "WITH w AS (SELECT 'tpch::pkg:ASIA' AS node, 0 AS depth UNION SELECT t, depth + 1 FROM w JOIN re ON f = node WHERE ty IN ('PACKAGE_TO_PACKAGE', 'PACKAGE_TO_UNIT', 'UNIT_TO_FUNCTION')), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node) SELECT id, coalesce(depth, (SELECT greatest(max(depth), 1) FROM m) + 1) AS rank FROM vi LEFT JOIN m ON node = id", recursive=True)
def bfs_rank(s, d):
    g = pr.graph(s, d)
    return traverse.ranks(g.relationships, view.nodes(g), "tpch::pkg:ASIA", _TREE).select("id", F.col("rank").cast("long").alias("rank"))


_MATCH = "SELECT DISTINCT o.id AS f, i.id AS t FROM ep o JOIN ep i ON o.identity = i.identity AND o.direction = 'outbound' AND i.direction = 'inbound'"


@Q.add("match_edges", f"SELECT 'tpch::rel:' || sha1(f || '|MATCHES|' || t) AS id, f AS fromNodeId, t AS toNodeId FROM ({_MATCH})")
def match_edges(s, d):
    return matching.match_edges(pr.endpoint_sites(s, d), pr.endpoints(s, d), P).select("id", "fromNodeId", "toNodeId")


@Q.add("dedupe_endpoints", "SELECT si.id, pos, direction, identity AS matchIdentity FROM si JOIN (SELECT id, min(pos) AS pos FROM si GROUP BY id) USING (id, pos)")
def dedupe_endpoints(s, d):
    return dedupe.first_by_id(pr.endpoint_sites(s, d)).select("id", "pos", "direction", "matchIdentity")


@Q.add("dedupe_edges", "SELECT id, f AS fromNodeId, t AS toNodeId, CAST(line AS INT) AS lineNumber FROM re WHERE ty = 'CALLS'")
def dedupe_edges(s, d):
    return dedupe.edges(pr.calls(s, d)).select("id", "fromNodeId", "toNodeId", "lineNumber")


@Q.add("walked_edges_dedupe", "SELECT f AS fromNodeId, t AS toNodeId, max(line) AS lineNumber FROM ca GROUP BY f, t")
def walked_edges_dedupe(s, d):
    walked = pr.calls(s, d).withColumn("order", -F.col("pos"))
    return dedupe.first_by(walked, ["fromNodeId", "toNodeId", "relationshipType"], "order").select("fromNodeId", "toNodeId", "lineNumber")


def _dirty(s, d):
    """The projected graph as a delta with faults: repeated calls, placeholders without a language, suppliers as functions."""
    g = pr.graph(s, d)
    at = F.lit(0).cast("long")
    fn = g.functions.withColumn("language", F.when(~F.col("isPlaceholder"), F.col("language")))
    site = pr.endpoint_sites(s, d)
    rel = pr.structure(s, d).withColumn("pos", at).withColumn("fromNodeType", F.when(F.col("relationshipType") == "TPCH_SUPPLIES", "CodeFunction").otherwise(F.col("fromNodeType")))
    calls = pr.calls(s, d).withColumn("pos", F.col("pos").cast("long"))
    return g.with_(packages=g.packages.withColumn("pos", at), units=g.units.withColumn("pos", at), functions=fn.withColumn("pos", at), endpoints=site, relationships=rel.unionByName(calls))


@Q.add("validate_delta", """
WITH x AS (SELECT 'package.projectFilePath.required' AS code, count(*) AS n FROM pk
  UNION ALL SELECT 'function.language.required', count(*) FROM fn WHERE ph
  UNION ALL SELECT 'endpoint.id.duplicate', (SELECT count(*) FROM si) - (SELECT count(DISTINCT id) FROM si)
  UNION ALL SELECT 'endpoint.projectFilePath.required', count(*) FROM si WHERE file IS NULL
  UNION ALL SELECT 'relationship.id.duplicate', (SELECT count(*) FROM ca) - (SELECT count(*) FROM (SELECT DISTINCT f, t FROM ca))
  UNION ALL SELECT 'relationship.duplicate', (SELECT count(*) FROM ca) - (SELECT count(*) FROM (SELECT DISTINCT f, t FROM ca))
  UNION ALL SELECT 'relationship.from.type.invalid', count(*) FROM re WHERE ty = 'TPCH_SUPPLIES')
SELECT code, n FROM x WHERE n > 0""")
def validate_delta(s, d):
    return delta.diagnostics(_dirty(s, d)).groupBy("code").agg(F.count("*").alias("n"))


def _incoming_functions(s, d):
    """A delta's functions: all parts, as placeholders where their size is below 20, and one for each supplier."""
    part = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("tpch::"), pr.part_function(F.col("p_partkey"))).alias("id"), (F.col("p_size") < 20).alias("isPlaceholder"))
    supp = s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("tpch::fn:supp.S"), F.col("s_suppkey").cast("string"), F.lit(".ship()")).alias("id"), F.lit(False).alias("isPlaceholder"))
    return part.unionByName(supp)


_PLAN = "SELECT 'tpch::fn:part.P' || p_partkey || '.use()' AS id, p_size < 20 AS ph2, CASE WHEN p_size < 20 THEN 'skip' ELSE 'update' END AS action FROM part UNION ALL SELECT 'tpch::fn:supp.S' || s_suppkey || '.ship()', false, 'insert' FROM supplier"


@Q.add("function_merge_plan", f"SELECT id, ph2 AS isPlaceholder, action FROM ({_PLAN})")
def function_merge_plan(s, d):
    return delta.save_plan(pr.functions(s, d), _incoming_functions(s, d))


@Q.add("upsert_functions", f"SELECT coalesce(p.id, fn.id) AS id, fn.qualifiedName, coalesce(p.ph2, fn.ph) AS isPlaceholder FROM fn FULL JOIN (SELECT * FROM ({_PLAN}) WHERE action <> 'skip') p ON p.id = fn.id")
def upsert_functions(s, d):
    stored = pr.functions(s, d).select("id", "qualifiedName", "isPlaceholder")
    rows = delta.save_plan(stored, _incoming_functions(s, d)).filter("action <> 'skip'").select("id", "isPlaceholder")
    named = rows.join(stored.select("id", "qualifiedName"), "id", "left")
    return store.upsert(stored, named)


@Q.add("insert_missing_edges", "SELECT DISTINCT f AS fromNodeId, t AS toNodeId FROM (SELECT 'tpch::unit:supp.S' || s_suppkey AS f, 'tpch::fn:part.P' || p_partkey || '.use()' AS t FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_orderkey % 100) WHERE (f, t) NOT IN (SELECT f, t FROM re WHERE ty = 'TPCH_SUPPLIES')")
def insert_missing_edges(s, d):
    l, part, supp = (s.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "part", "supplier"))
    pair = l.select("l_suppkey", (F.col("l_orderkey") % 100).alias("k")).distinct().join(part.select("p_partkey"), F.col("k") == F.col("p_partkey")).join(supp.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = conform(pr.edge(pair, F.concat(F.lit("unit:supp.S"), F.col("l_suppkey").cast("string")), "TPCH_SUPPLIES", pr.part_function(F.col("p_partkey"))), RELATIONSHIP)
    return delta.missing_edges(pr.relationships(s, d), rows, P).select("fromNodeId", "toNodeId").distinct()


@Q.add("placeholders", "SELECT DISTINCT t AS id, 'use' AS name, t[10:] AS qualifiedName, 'use()' AS signature FROM ca WHERE t NOT IN (SELECT id FROM fn WHERE NOT ph)")
def placeholders(s, d):
    known = pr.functions(s, d).filter("not isPlaceholder")
    return changes.placeholders(known, pr.relationships(s, d).filter("relationshipType = 'CALLS'"), P).select("id", "name", "qualifiedName", "signature")


@Q.add("delete_file_calls", "SELECT ty AS relationshipType, count(*) AS n FROM re WHERE NOT (kind = 'CALL' AND f IN (SELECT id FROM fn WHERE file IN (SELECT 'cust/c' || user_id || '.java' FROM events WHERE event_type = 'error'))) GROUP BY ty")
def delete_file_calls(s, d):
    files = ev.change_events(s.read.parquet(f"{d}/events.parquet")).filter("changeType = 'SOURCE_DELETED'").select(F.col("file").alias("path"))
    return view.edges_by_type(store.delete_file_calls(_filled(s, d), pr.functions(s, d), P, files))


_GONE = "(SELECT id FROM fn WHERE ph)"


@Q.add("detach_delete", f"SELECT 'functions' AS name, count(*) AS n FROM fn WHERE NOT ph UNION ALL SELECT 'relationships', count(*) FROM re WHERE f NOT IN {_GONE} AND t NOT IN {_GONE}")
def detach_delete(s, d):
    g = pr.graph(s, d)
    out = store.delete_nodes(g, P, g.functions.filter("isPlaceholder").select("id"))
    return view.project_counts(out, P).filter(F.col("name").isin("functions", "relationships"))


_CHANGED = "(SELECT 'part/p' || p_partkey || '.java' FROM part WHERE p_size >= 40)"


@Q.add("cascade_files", f"SELECT DISTINCT b.file AS projectFilePath, b.repo AS gitRepoUrl, 'main' AS gitBranch FROM re JOIN fn a ON a.id = re.t JOIN fn b ON b.id = re.f WHERE kind = 'CALL' AND a.file IN {_CHANGED} AND b.file NOT IN {_CHANGED}")
def cascade_files(s, d):
    g = pr.graph(s, d)
    g = g.with_(relationships=with_defaults(g.relationships))
    files = g.functions.filter("isPlaceholder").select(F.col("projectFilePath").alias("path"))
    return changes.dependents(g, P, files)


@Q.add("bind_endpoint_range", "SELECT pos AS site, fn.id AS function FROM si JOIN fn ON fn.file = si.file AND line BETWEEN lo AND hi")
def bind_endpoint_range(s, d):
    sites = pr.endpoint_sites(s, d).filter("startLine is not null").select(F.col("pos").alias("site"), "projectFilePath", "startLine")
    return matching.bind_by_line(sites, pr.functions(s, d))


@Q.add("scoped_ids", "SELECT id, id[7:] AS raw_id, id AS again FROM fn")
def scoped_ids(s, d):
    p = F.lit(P)
    return pr.functions(s, d).select("id", ids.raw(p, F.col("id")).alias("raw_id"), ids.scoped(p, ids.scoped(p, ids.raw(p, F.col("id")))).alias("again"))


@Q.add("edge_ids", "SELECT id, f AS fromNodeId, t AS toNodeId FROM re")
def edge_ids(s, d):
    return pr.relationships(s, d).select("id", "fromNodeId", "toNodeId")


@Q.add("match_identity", "SELECT pos, type AS endpointType, identity FROM si")
def match_identity(s, d):
    return pr.endpoint_sites(s, d).select("pos", "endpointType", ids.match_identity(F.col("endpointType")).alias("identity"))


@Q.add("infer_language", "SELECT page_id, CASE WHEN page_id % 8 = 0 THEN 'java' WHEN page_id % 8 = 1 THEN 'go' WHEN page_id % 8 = 2 THEN 'python' WHEN page_id % 8 = 3 THEN 'php' WHEN page_id % 8 = 4 THEN 'kotlin' WHEN page_id % 8 = 5 THEN 'javascript' WHEN page_id % 8 = 6 THEN 'typescript' ELSE 'java' END AS language FROM pages", base=False)
def infer_language(s, d):
    suffix = F.element_at(F.array(*map(F.lit, (".java", ".go", ".PY", ".php", ".kts", ".jsx", ".tsx", ".html"))), (F.col("page_id") % 8 + 1).cast("int"))
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", ids.language_of(F.concat(F.lit("src/p"), F.col("page_id").cast("string"), suffix)).alias("language"))


@Q.add("method_signature", "SELECT id, name, name || '()' AS signature FROM fn")
def method_signature(s, d):
    q = F.col("qualifiedName")
    return pr.functions(s, d).select("id", ids.method_name(q).alias("name"), ids.signature_of(q).alias("signature"))


@Q.add("client_stub_nodes", "SELECT id, 'UNIT' AS type FROM un UNION ALL SELECT DISTINCT x, 'CodeElement' FROM (SELECT f AS x FROM re UNION SELECT t FROM re) WHERE x NOT IN (SELECT id FROM un)")
def client_stub_nodes(s, d):
    g = pr.graph(s, d)
    return view.with_stubs(view.nodes(g).filter("type = 'UNIT'"), g.relationships)


@Q.add("graph_merge", "SELECT coalesce(a.id, b.id) AS id, a.name, coalesce(b.repo, a.repo) AS gitRepoUrl FROM (SELECT * FROM un) a FULL JOIN (SELECT id, 'git@example/parts.git' AS repo FROM un WHERE repo IS NULL UNION ALL SELECT id, 'git@example/fn.git' FROM fn WHERE ph) b ON a.id = b.id")
def graph_merge(s, d):
    u, f = pr.units(s, d), pr.functions(s, d)
    new = u.filter("gitRepoUrl is null").select("id", F.lit("git@example/parts.git").alias("gitRepoUrl")).unionByName(f.filter("isPlaceholder").select("id", F.lit("git@example/fn.git").alias("gitRepoUrl")))
    return view.merged(u.select("id", "name", "gitRepoUrl"), new)


@Q.add("change_stream_apply", """SELECT 'cust/c' || user_id || '.java' AS file, arg_max(event_id, (ts, event_id)) AS "eventId",
  arg_max(CASE event_type WHEN 'signup' THEN 'SOURCE_ADDED' WHEN 'error' THEN 'SOURCE_DELETED' WHEN 'purchase' THEN 'SOURCE_MODIFIED' ELSE 'CASCADE_UPDATE' END, (ts, event_id)) AS "changeType", count(*) AS n FROM events GROUP BY user_id""", base=False)
def change_stream_apply(s, d):
    return ev.run_stream(s, f"{d}/events.parquet")


@Q.add("apply_delta", """
WITH x AS (SELECT 'functions' AS name, (SELECT count(*) FROM fn) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'units', count(*) FROM un UNION ALL SELECT 'packages', count(*) FROM pk UNION ALL SELECT 'endpoints', count(*) FROM ep
 UNION ALL SELECT 'relationships', (SELECT count(*) FROM re) + (SELECT count(*) FROM (""" + _MATCH + """)) + (SELECT count(*) FROM supplier))
SELECT name, n FROM x""")
def apply_delta(s, d):
    """The stored graph without endpoints and calls, and a delta with suppliers' functions, all endpoint sites and calls."""
    g = pr.graph(s, d)
    at = F.lit(0).cast("long")
    stored = g.with_(relationships=pr.structure(s, d), endpoints=g.endpoints.limit(0))
    supp = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"))
    fn = pr._node(supp, F.concat(F.lit("fn:supp.S"), F.col("k"), F.lit(".ship()")), F.lit("ship"), F.concat(F.lit("supp.S"), F.col("k"), F.lit(".ship()")), F.concat(F.lit("supp/s"), F.col("k"), F.lit(".java")))
    own = pr.edge(supp, F.concat(F.lit("unit:supp.S"), F.col("k")), "UNIT_TO_FUNCTION", F.concat(F.lit("fn:supp.S"), F.col("k"), F.lit(".ship()")))
    rel = conform(own, RELATIONSHIP).withColumn("pos", at).unionByName(pr.calls(s, d).withColumn("pos", F.col("pos").cast("long")))
    sites = pr.endpoint_sites(s, d).withColumn("projectFilePath", F.coalesce("projectFilePath", F.lit("web.java")))
    d_graph = g.with_(packages=g.packages.limit(0).withColumn("pos", at), units=g.units.limit(0).withColumn("pos", at), functions=conform(fn, g.functions.schema).withColumn("pos", at), endpoints=sites, relationships=rel)
    return view.project_counts(delta.apply(stored, d_graph, P)[0], P)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from codeloom import source_queries

    return {**Q.run, **source_queries.Q.run}


def oracle_sql() -> dict[str, str]:
    from codeloom import source_queries

    return {**Q.sql, **source_queries.Q.sql}
