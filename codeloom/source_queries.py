"""Registered queries over sources, configuration, deltas and changes that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import ids
from codeloom.operators import changes, dedupe, delta, filters, matching, view
from codeloom.operators.store import delete_edges
from codeloom.operators.traverse import written
from codeloom.plans import projection as pr
from codeloom.plans.sources import config_lines, java_sources, sources_sql
from codeloom.queries import START, Queries, walk_sql
from codeloom.schema import FUNCTION, RELATIONSHIP, TABLES, Graph, conform, with_defaults
from codeloom.sources import config_scan, delta_json, endpoint_rules, java_source

P = pr.PROJECT
Q = Queries()


def _sql(body: str) -> str:
    """A body's SQL after the named tables of the derived sources."""
    return f"{sources_sql()} {body}"


# -- Java sources: see plans.sources for the files


@Q.add("java_units", _sql("SELECT qualified, file, unitType, modifiers, startLine, endLine FROM ju"), base=False)
def java_units(s, d):
    t = java_source.scan(java_sources(s, d)).types
    return t.select("qualified", "file", "unitType", F.array_join("modifiers", " ").alias("modifiers"), "startLine", "endLine")


@Q.add("java_functions", _sql('SELECT "full", file, modifiers, returnType, isConstructor, startLine, endLine FROM jf'), base=False)
def java_functions(s, d):
    m = java_source.scan(java_sources(s, d)).methods
    return m.select("full", "file", F.array_join("modifiers", " ").alias("modifiers"), F.coalesce("returnType", F.lit("")).alias("returnType"), "isConstructor", "startLine", "endLine")


@Q.add("java_relationships", _sql("SELECT 'rel:' || sha1(f || '|' || ty || '|' || t) AS id, f AS fromNodeId, ty AS relationshipType, t AS toNodeId, line AS lineNumber FROM je"), base=False)
def java_relationships(s, d):
    return java_source.graph(java_sources(s, d)).relationships.select("id", "fromNodeId", "relationshipType", "toNodeId", "lineNumber")


@Q.add("java_call_filters", _sql("SELECT name, count(*) AS n FROM jf WHERE name IN ('getTotal', 'setTotal') GROUP BY name"), base=False)
def java_call_filters(s, d):
    """Methods that bean filters take out of calls: accessors whose body only reads or writes a field."""
    m = java_source.scan(java_sources(s, d)).methods
    args = (F.col("name"), F.col("args"), F.col("returnType"))
    gone = filters.pipeline(m, filters.accessor(*args), filters.trivial_accessor(*args, F.col("body"), F.col("last_parameter")))
    return gone.groupBy("name").agg(F.count("*").alias("n"))


# -- configuration and endpoint rules


@Q.add("config_values", "SELECT 'service.' || lower(replace(n_name, ' ', '-')) || '.base-path' AS key, '/api/' || n_nationkey AS value FROM nation UNION ALL SELECT 'topic.' || r_regionkey, 'region-' || r_regionkey || '#x' FROM region", base=False)
def config_values(s, d):
    found = config_scan.merged(config_scan.values(config_lines(s, d)))
    return found.select("key", F.explode("values").alias("value"))


_RULES = [
    endpoint_rules.Rule("get", "HTTP", "inbound", r"@(Get|Post)Mapping\(\"([^\"]*)\"\)", value=2, method=1),
    endpoint_rules.Rule("send", "MQ", "outbound", r"kafka\.send\(\"([^\"]*)\"", value=1),
]


@Q.add(
    "endpoint_rules",
    """WITH x AS (SELECT 'supp/S' || s_suppkey || '.java' AS file, 'HTTP' AS endpointType, 'inbound' AS direction, 'HTTP:GET:/api/' || s_nationkey || '/s/{param}' AS matchIdentity FROM supplier
      UNION ALL SELECT 'supp/S' || s_suppkey || '.java', 'MQ', 'outbound', 'MQ:region-' || n_regionkey || '#x' FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT 'endpoint:' || direction || ':' || endpointType || ':' || sha1(matchIdentity) AS id, file AS projectFilePath, matchIdentity FROM x""",
    base=False,
)
def rules(s, d):
    nation, supp = (s.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "supplier"))
    key = F.lower(F.translate("n_name", " ", "-"))
    raw = F.concat(F.lit('class S {\n  @GetMapping("${service.'), key, F.lit('.base-path}/s/{id}")\n  void one() { kafka.send("${topic.'), F.col("n_regionkey").cast("string"), F.lit(':none}", 1); }\n}\n'))
    src = supp.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supp/S"), F.col("s_suppkey").cast("string"), F.lit(".java")).alias("file"), raw.alias("raw"), F.lit(P).alias("projectName"))
    config = config_scan.merged(config_scan.values(config_lines(s, d)))
    return endpoint_rules.extract(src, _RULES, config).select("id", "projectFilePath", "matchIdentity")


@Q.add(
    "binding_edges",
    """WITH b AS (SELECT si.id AS site, any_value(direction) AS direction, arg_min(fn.id, (pos, lo, fn.id)) AS fun FROM si JOIN fn ON fn.file = si.file AND line BETWEEN lo AND hi GROUP BY si.id),
    x AS (SELECT CASE direction WHEN 'inbound' THEN site ELSE fun END AS f, CASE direction WHEN 'inbound' THEN 'ENDPOINT_TO_FUNCTION' ELSE 'FUNCTION_TO_ENDPOINT' END AS ty, CASE direction WHEN 'inbound' THEN fun ELSE site END AS t FROM b)
    SELECT 'tpch::rel:' || sha1(f || '|' || ty || '|' || t) AS id, f AS fromNodeId, ty AS relationshipType, t AS toNodeId FROM x""",
)
def binding_edges(s, d):
    """Each endpoint is bound to the function around its first site that lies in one."""
    sites = pr.endpoint_sites(s, d).filter("startLine is not null").select(F.col("pos").alias("site"), "id", "direction", "projectFilePath", "startLine", F.lit(None).cast("string").alias("function"))
    bound = matching.bind(sites.drop("id", "direction"), pr.functions(s, d)).join(sites.select("site", "id", "direction"), "site")
    first = dedupe.first_by(bound, ["id"], "site")
    return matching.binding_edges(first.select(F.col("id").alias("site"), "function"), first.select("id", "direction"), P).select("id", "fromNodeId", "relationshipType", "toNodeId")


# -- deltas


def _deltas(s, d) -> DataFrame:
    """One delta document for each nation: its customers as units of a project named by their ids alone, wrapped every other time."""
    nation, cust = (s.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "customer"))
    key = F.col("c_custkey").cast("string")
    unit = F.struct(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("#unit:C"), key).alias("id"), F.concat(F.lit("C"), key).alias("name"), F.lit("kotlin").alias("language"), F.concat(F.lit("c"), key, F.lit(".kt")).alias("projectFilePath"))
    docs = cust.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    docs = nation.join(docs, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", F.to_json(F.struct("units")).alias("body"))
    wrapped = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('{"graph":'), F.col("body"), F.lit("}"))).otherwise(F.col("body"))
    return docs.select(F.from_json(wrapped, delta_json._RAW).alias("x"), "n_nationkey").select("x.*", F.col("n_nationkey").alias("delta_id"))


@Q.add("import_delta", "SELECT c_nationkey AS delta_id, 'n' || c_nationkey AS project, 'kotlin' AS language, count(*) AS units, count(*) AS files, 'SOURCE_MODIFIED' AS change FROM customer GROUP BY c_nationkey", base=False)
def import_delta(s, d):
    out = delta_json.with_scope(_deltas(s, d))
    return out.select("delta_id", F.col("scope.projectName").alias("project"), F.col("scope.language").alias("language"), F.size("units").cast("long").alias("units"), F.size("scope.sourceFiles").cast("long").alias("files"), F.col("scope.changeType").alias("change"))


@Q.add("import_delta_units", "SELECT 'n' || c_nationkey || '#unit:C' || c_custkey AS id, 'n' || c_nationkey AS projectName FROM customer", base=False)
def import_delta_units(s, d):
    return delta_json.tables(delta_json.with_scope(_deltas(s, d))).units.select("id", "projectName")


@Q.add(
    "dedupe_edges_ordered",
    """WITH e AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'e' || (l_orderkey % 50) || '-' || l_linenumber END AS id, 'o' || l_orderkey AS f, 'p' || (l_partkey % 100) AS t, l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
    k AS (SELECT f, t, min(pos) AS pos FROM e GROUP BY f, t)
    SELECT count(*) AS n, sum(pos) AS total FROM (SELECT DISTINCT f, t, pos FROM e JOIN k USING (f, t, pos) WHERE id IS NULL)""",
    base=False,
)
def dedupe_edges_ordered(s, d):
    """Edges whose ids are shared across different ends, or missing; the rows without an id that stay.

    An edge without an id is compared by its ends only; here every other edge with its ends has
    them for the first time or comes later, so the kept ones are first of their ends.
    """
    l = s.read.parquet(f"{d}/lineitem.parquet")
    rows = l.select(
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("e"), (F.col("l_orderkey") % 50).cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))).alias("id"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("fromNodeId"), F.concat(F.lit("p"), (F.col("l_partkey") % 100).cast("string")).alias("toNodeId"),
        F.lit("CALLS").alias("relationshipType"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("pos"),
    )
    first = rows.groupBy("fromNodeId", "toNodeId").agg(F.min("pos").alias("pos"))
    out = dedupe.edges(conform(rows, RELATIONSHIP, "pos")).filter("id IS NULL").join(first, ["fromNodeId", "toNodeId", "pos"], "left_semi")
    return out.agg(F.count("*").alias("n"), F.sum("pos").alias("total"))


# -- changes of files


def _stored(s, d) -> Graph:
    """The projected graph without endpoints, written once, as stored calls have their kinds."""
    g = pr.graph(s, d)
    g = g.with_(relationships=with_defaults(g.relationships), endpoints=g.endpoints.limit(0))
    return Graph(**{name: written(df) for name, df in g.tables().items()})


def _files(g: Graph) -> DataFrame:
    """The files of parts that are placeholders."""
    return g.functions.filter("isPlaceholder").select(F.col("projectFilePath").alias("path"))


def _delta_of(s, functions: DataFrame, relationships: DataFrame) -> Graph:
    at = F.lit(0).cast("long")
    none = {t: s.createDataFrame([], TABLES[t]).withColumn("pos", at) for t in ("packages", "units", "endpoints")}
    return Graph(**none, functions=conform(functions, FUNCTION).withColumn("pos", at), relationships=conform(relationships, RELATIONSHIP).withColumn("pos", at))


def _revised(g: Graph) -> DataFrame:
    """The changed files' functions as a parser returns them: every second part is gone, the others are real."""
    key = F.regexp_extract("name2", r"P(\d+)", 1).cast("long")
    f = g.functions.filter("isPlaceholder").withColumn("name2", F.col("qualifiedName"))
    return f.filter(key % 2 == 0).drop("name2").withColumn("isPlaceholder", F.lit(False))


_HELD = "SELECT id, ph AS isPlaceholder FROM fn"
_EDGES = "id, f AS fromNodeId, t AS toNodeId"
_PH = "(SELECT id FROM fn WHERE ph)"
_ODD = "(SELECT id FROM fn WHERE ph AND CAST(regexp_extract(id, 'P([0-9]+)', 1) AS INT) % 2 = 1)"


@Q.add("change_deleted", f"SELECT 'node' AS kind, id FROM fn WHERE NOT ph UNION ALL SELECT 'edge', id FROM re WHERE f NOT IN {_PH} AND t NOT IN {_PH}")
def change_deleted(s, d):
    g = _stored(s, d)
    out = changes.removed(g, P, _files(g))[0]
    return out.functions.select(F.lit("node").alias("kind"), "id").unionByName(out.relationships.select(F.lit("edge").alias("kind"), "id"))


@Q.add("change_deleted_events", f"SELECT DISTINCT 'CASCADE_UPDATE' AS changeType, b.file AS file, b.repo AS gitRepoUrl FROM re JOIN fn a ON a.id = re.t JOIN fn b ON b.id = re.f WHERE kind = 'CALL' AND a.ph AND b.file NOT IN (SELECT file FROM fn WHERE ph)")
def change_deleted_events(s, d):
    g = _stored(s, d)
    return changes.removed(g, P, _files(g))[1].select("changeType", F.col("newProjectFilePath").alias("file"), "gitRepoUrl")


@Q.add(
    "change_modified",
    f"SELECT 'node' AS kind, id, false AS isPlaceholder FROM fn WHERE id NOT IN {_ODD} UNION ALL SELECT 'edge', id, NULL FROM re WHERE f NOT IN {_PH} AND (t NOT IN {_PH} OR (kind = 'CALL' AND t NOT IN {_ODD}))",
)
def change_modified(s, d):
    """Changed files lose every second function; calls of other files into those that stay are kept."""
    g = _stored(s, d)
    new = _delta_of(s, _revised(g), s.createDataFrame([], RELATIONSHIP))
    out = changes.modified(g, new, P, _files(g))[0]
    nodes = out.functions.select(F.lit("node").alias("kind"), "id", F.coalesce("isPlaceholder", F.lit(False)).alias("isPlaceholder"))
    return nodes.unionByName(out.relationships.select(F.lit("edge").alias("kind"), "id", F.lit(None).cast("boolean").alias("isPlaceholder")))


_NEW = "(SELECT 'tpch::fn:supp.S' || s_suppkey || '.ship()' AS f, 'tpch::fn:ext.X' || (s_suppkey % 3) || '.call(int)' AS t FROM supplier)"


@Q.add(
    "change_added",
    f"""SELECT id, isPlaceholder, name FROM (SELECT id, ph AS isPlaceholder, name FROM fn) UNION ALL SELECT DISTINCT f, false, 'ship' FROM {_NEW} UNION ALL SELECT DISTINCT t, true, 'call' FROM {_NEW}""",
)
def change_added(s, d):
    """Suppliers' new functions and their calls of functions that nothing declares."""
    g = _stored(s, d)
    out = changes.added(g, _added(s, d), P)[0]
    return out.functions.select("id", F.coalesce("isPlaceholder", F.lit(False)).alias("isPlaceholder"), "name")


def _added(s, d) -> Graph:
    supp = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"), (F.col("s_suppkey") % 3).cast("string").alias("x"))
    own = F.concat(F.lit("fn:supp.S"), F.col("k"), F.lit(".ship()"))
    fn = pr._node(supp, own, F.lit("ship"), F.concat(F.lit("supp.S"), F.col("k"), F.lit(".ship()")), F.concat(F.lit("supp/s"), F.col("k"), F.lit(".java"))).withColumn("isPlaceholder", F.lit(False))
    call = pr.edge(supp, own, "CALLS", F.concat(F.lit("fn:ext.X"), F.col("x"), F.lit(".call(int)")))
    return _delta_of(s, fn, call)


@Q.add("node_events", "SELECT 'INSERT' AS operation, 'CodeFunction' AS nodeType, 'tpch::fn:supp.S' || s_suppkey || '.ship()' AS nodeId FROM supplier UNION ALL SELECT 'UPDATE', 'CodeFunction', id FROM fn WHERE NOT ph")
def node_events(s, d):
    """What a delta of suppliers' new functions and all real ones tells listeners."""
    g, new = _stored(s, d), _added(s, d)
    again = conform(g.functions.filter("NOT isPlaceholder"), FUNCTION).withColumn("pos", F.lit(0).cast("long"))
    events = delta.apply(g, new.with_(functions=new.functions.unionByName(again), relationships=new.relationships.limit(0)), P)[1]
    return events.select("operation", "nodeType", "nodeId")


_FRESH = f"(SELECT DISTINCT f, t FROM ca WHERE f IN (SELECT id FROM fn WHERE file IN (SELECT 'cust/c' || user_id || '.java' FROM events WHERE event_type = 'error')) AND line = 1)"


@Q.add(
    "change_cascade",
    f"SELECT id FROM re WHERE NOT (kind = 'CALL' AND f IN (SELECT id FROM fn WHERE file IN (SELECT 'cust/c' || user_id || '.java' FROM events WHERE event_type = 'error'))) UNION ALL SELECT 'tpch::rel:' || sha1(f[7:] || '|CALLS|' || t[7:]) FROM {_FRESH}",
)
def change_cascade(s, d):
    """Files of error events keep only the calls of a fresh parse: those of first line items."""
    from codeloom.streaming import events as ev

    g = _stored(s, d)
    files = ev.change_events(s.read.parquet(f"{d}/events.parquet")).filter("changeType = 'SOURCE_DELETED'").select(F.col("file").alias("path")).distinct()
    own = g.functions.select(F.col("id").alias("fromNodeId"), F.col("projectFilePath").alias("path")).join(files, "path", "left_semi")
    fresh = dedupe.first_by(pr.calls(s, d).filter("lineNumber = 1"), ["id"], "pos").join(own.select("fromNodeId"), "fromNodeId", "left_semi")
    return changes.handle(g, "CASCADE_UPDATE", P, files, _delta_of(s, s.createDataFrame([], FUNCTION), fresh)).relationships.select("id")


@Q.add("rebuild_calls", "SELECT id, name, ph AS isPlaceholder FROM fn WHERE NOT ph UNION ALL SELECT DISTINCT t, 'use', true FROM ca WHERE t NOT IN (SELECT id FROM fn WHERE NOT ph)")
def rebuild_calls(s, d):
    """All calls over a store that lacks the placeholder parts: these come back as placeholders."""
    g = _stored(s, d)
    bare = g.with_(functions=g.functions.filter("NOT isPlaceholder"))
    out = changes.rebuild_calls(bare, with_defaults(g.relationships.filter("relationshipType = 'CALLS'")), P)
    return out.functions.select("id", "name", F.coalesce("isPlaceholder", F.lit(False)).alias("isPlaceholder"))


@Q.add("delete_edges", "SELECT id FROM re WHERE ty <> 'TPCH_SUPPLIES'")
def delete_edges_(s, d):
    rel = pr.relationships(s, d)
    return delete_edges(rel, P, rel.filter("relationshipType = 'TPCH_SUPPLIES'").select("id")).select("id")


# -- what a client loads


@Q.add("client_subgraph", f"{walk_sql('forward')} SELECT id, type FROM vi WHERE id IN (SELECT node FROM m) OR name = 'use' OR id = '{START}'", recursive=True)
def client_subgraph(s, d):
    return view.subgraph(pr.graph(s, d), START, "use", 3, "forward")[0].select("id", "type")


@Q.add("client_subgraph_edges", f"{walk_sql('forward')}, i AS (SELECT node FROM m WHERE depth < 3) SELECT id, f AS fromNodeId, t AS toNodeId FROM re WHERE f IN (SELECT node FROM i)", recursive=True)
def client_subgraph_edges(s, d):
    return view.subgraph(pr.graph(s, d), START, "use", 3, "forward")[1].select("id", "fromNodeId", "toNodeId")


@Q.add("endpoint_fields", "SELECT event_id AS pos, event_type AS topic, user_id % 2 = 0 AS isExternal, 'MQ' AS endpointType FROM events", base=False)
def endpoint_fields(s, d):
    """Values of rules put into endpoint rows by name; the name that no column has is ignored."""
    e = s.read.parquet(f"{d}/events.parquet")
    fields = F.create_map(F.lit("topic"), F.col("event_type"), F.lit("isExternal"), (F.col("user_id") % 2 == 0).cast("string"), F.lit("noSuchField"), F.lit("x"))
    rows = e.select(F.col("event_id").alias("pos"), F.lit("MQ").alias("endpointType"), F.lit("old").alias("topic"), fields.alias("fields"))
    return endpoint_rules.with_fields(rows).select("pos", "topic", "isExternal", "endpointType")


# -- texts


@Q.add("repo_names", "SELECT DISTINCT repo AS url, 'git@example/' || regexp_replace(split_part(repo, '/', 2), '\\.git$', '') AS name FROM un WHERE repo IS NOT NULL")
def repo_names(s, d):
    urls = pr.units(s, d).filter("gitRepoUrl is not null").select(F.col("gitRepoUrl").alias("url")).distinct()
    return urls.select("url", ids.repo_display_name(F.col("url")).alias("name"))


@Q.add("project_paths", "SELECT file, '/w/shop' AS root, regexp_replace(file, '/[^/]*$', '') AS directory FROM un")
def project_paths(s, d):
    """Roots told by absolute and relative paths, paths told by roots, and directories."""
    u = pr.units(s, d).select(F.concat(F.lit("\\w\\shop\\"), F.translate("projectFilePath", "/", "\\")).alias("absolute"), "projectFilePath")
    root = ids.project_root(F.col("absolute"), F.col("projectFilePath"))
    u = u.withColumn("root", root).withColumn("file", ids.project_file_path(F.lit(None).cast("string"), F.col("root"), F.col("absolute")))
    return u.select("file", "root", ids.parent_directory(F.col("file")).alias("directory"))


@Q.add(
    "apply_delta_rows",
    f"""SELECT 'function' AS kind, id FROM (SELECT id FROM fn UNION ALL SELECT DISTINCT f FROM {_NEW}) UNION ALL SELECT 'edge', id FROM re
    UNION ALL SELECT 'edge', 'tpch::rel:' || sha1(f[7:] || '|CALLS|' || t[7:]) FROM {_NEW}""",
)
def apply_delta_rows(s, d):
    """The rows after a delta of suppliers' new functions and calls, which repeats calls that are stored."""
    g, new = _stored(s, d), _added(s, d)
    old = conform(g.relationships.filter("relationshipType = 'CALLS'"), RELATIONSHIP).withColumn("pos", F.lit(1).cast("long"))
    out = delta.apply(g, new.with_(relationships=new.relationships.unionByName(old)), P)[0]
    return out.functions.select(F.lit("function").alias("kind"), "id").unionByName(out.relationships.select(F.lit("edge").alias("kind"), "id"))
