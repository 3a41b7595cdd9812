"""Graph operators on small tables with known results, and traversal against a plain model."""

import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from codeloom.functions import ids
from codeloom.operators import changes, dedupe, delta, lookup, matching, store, traverse, view
from codeloom.schema import ENDPOINT, FUNCTION, PACKAGE, RELATIONSHIP, RELATIONSHIP_TYPES, UNIT, Graph, with_defaults


def rows(spark, schema, *dicts, pos=False):
    df = spark.createDataFrame([tuple(d.get(f.name) for f in schema.fields) for d in dicts], schema)
    if pos:
        df = df.coalesce(1).withColumn("pos", F.monotonically_increasing_id())
    return df


def node(ident, project="demo", file="src/A.java", **more):
    return {"id": ident, "name": ident, "qualifiedName": ident, "language": "java", "projectName": project, "projectFilePath": file, **more}


def edge(a, kind, b, project="demo", ident=None, **more):
    return {"id": ident or f"{a}-{kind}-{b}", "fromNodeId": a, "toNodeId": b, "relationshipType": kind, "language": "java", "projectName": project, **more}


def graph(spark, packages=(), units=(), functions=(), endpoints=(), relationships=(), pos=False):
    make = lambda s, d: rows(spark, s, *d, pos=pos)
    return Graph(make(PACKAGE, packages), make(UNIT, units), make(FUNCTION, functions), make(ENDPOINT, endpoints), make(RELATIONSHIP, relationships))


def ids_of(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return df.select(column.alias("c")).first()["c"]


def test_identifiers(spark):
    p, i = F.col("p"), F.col("i")
    assert one(spark, ids.scoped(p, ids.scoped(p, i)), p="demo", i="fn:a") == "demo::fn:a"
    assert one(spark, ids.scoped(p, i), p=" ", i="fn:a") == "fn:a"
    assert one(spark, ids.raw(p, i), p="demo", i="demo::fn:a") == "fn:a"
    assert one(spark, ids.relationship_id(p, F.lit("CALLS"), i), p=" a\t", i="b") == "rel:" + __import__("hashlib").sha1(b"a|CALLS|b").hexdigest()
    assert one(spark, ids.http_identity(p, i, F.lit(None)), p=" get ", i="/u") == "HTTP:GET:/u"
    assert one(spark, ids.http_identity(F.lit(None).cast("string"), i, F.lit(None)), i="/u") == "HTTP:ANY:/u"
    assert one(spark, ids.relationship_type(p), p=" java_extends ") == "JAVA_EXTENDS"
    assert one(spark, ids.relationship_type(p), p="1x") is None
    q = "demo.Service.load(java.lang.String)"
    assert one(spark, ids.method_name(p), p=q) == "load"
    assert one(spark, ids.signature_of(p), p=q) == "load(java.lang.String)"
    assert one(spark, ids.display_name(p), p="demo::fn:" + q) == q
    assert one(spark, ids.project_root(p, i), p="/w/demo/src/A.java", i="src/A.java") == "/w/demo"
    assert one(spark, ids.language_of(p), p="a/B.KTS") == "kotlin"
    assert one(spark, ids.repo_display_name(p), p="git@example/team/demo.git") == "team/demo"
    assert one(spark, ids.is_blank(p), p=" \t") is True or one(spark, ids.is_blank(p), p=" \t") is True


def test_declared_types_fill_blanks(spark):
    df = with_defaults(rows(spark, RELATIONSHIP, *[edge("a", t, "b") for t, *_ in RELATIONSHIP_TYPES], edge("a", "JAVA_EXTENDS", "b")))
    got = {r["relationshipType"]: (r["relationshipKind"], r["fromNodeType"], r["toNodeType"]) for r in df.collect()}
    assert {t: got[t] for t, *_ in RELATIONSHIP_TYPES} == {t: tuple(x) for t, *x in RELATIONSHIP_TYPES}
    assert got["JAVA_EXTENDS"] == (None, None, None)


def test_project_isolation_and_reverse_callers(spark):
    f = rows(spark, FUNCTION, node("callee", file="src/Callee.java"), node("caller", file="src/Caller.java", gitRepoUrl="git@example/demo.git", gitBranch="main"), node("f2", "other"))
    r = rows(spark, RELATIONSHIP, edge("caller", "CALLS", "callee"), edge("caller", "UNIT_TO_FUNCTION", "callee"), edge("f2", "CALLS", "callee", "other"))
    assert ids_of(lookup.in_file(f, "other", "src/A.java")) == ["f2"]
    found = lookup.callers_of_files(f, with_defaults(r), "demo", spark.createDataFrame([("src/Callee.java",)], "path string")).collect()
    assert [tuple(x)[1:] for x in found] == [("src/Caller.java", "git@example/demo.git", "main")]
    wanted = spark.createDataFrame([("caller",), ("none",)], "wanted string")
    assert ids_of(lookup.existing_ids(f, "demo", wanted)) == ["caller"]
    assert ids_of(lookup.existing_ids(f, "other", wanted)) == []


def test_delete_detaches_edges_of_the_project_only(spark):
    g = graph(spark, packages=[node("p")], units=[node("u"), node("u", "other")], functions=[node("f")], relationships=[edge("u", "X", "f"), edge("f", "X", "u", "other"), edge("p", "X", "q"), edge("a", "X", "b", ident="f")])
    out = store.delete_nodes(g, "demo", spark.createDataFrame([("u",), ("f",), ("p",)], "id string"))
    assert ids_of(out.packages) == ["p"] and ids_of(out.functions) == []
    assert [r["projectName"] for r in out.units.collect()] == ["other"]
    assert ids_of(out.relationships) == ["f-X-u", "p-X-q"]


def test_upserts(spark):
    old = rows(spark, UNIT, node("a", name="1"), node("b"))
    new = rows(spark, UNIT, node("a", name="2"), node("a", name="3"), node("c"), pos=True)
    got = {r["id"]: r["name"] for r in store.upsert(old, new, "pos").collect()}
    assert got == {"a": "3", "b": "b", "c": "c"}
    assert ids_of(store.update(old, rows(spark, UNIT, node("a"), node("zz")))) == ["a", "b"]
    e = store.insert_edges(rows(spark, RELATIONSHIP), rows(spark, RELATIONSHIP, edge("a", "X", "b"), edge("a", "X", "lost")), old)
    assert ids_of(e) == ["a-X-b"]


def test_save_plan(spark):
    stored = rows(spark, FUNCTION, node("real", isPlaceholder=False), node("ph", isPlaceholder=True))
    new = rows(spark, FUNCTION, *[node(i, isPlaceholder=p) for i in ("real", "ph", "new") for p in (False, True)])
    got = {(r["id"], r["isPlaceholder"]): r["action"] for r in delta.save_plan(stored, new).collect()}
    assert got == {("real", False): "update", ("real", True): "skip", ("ph", False): "update", ("ph", True): "skip", ("new", False): "insert", ("new", True): "insert"}


def test_edges_deduplicate_in_order(spark):
    r = random.Random(3)
    for trial in range(4):
        got_rows = [edge(f"n{r.randrange(3)}", "X", f"m{r.randrange(3)}", ident=f"i{r.randrange(6)}") for _ in range(30)]
        seen_i, seen_k, want = set(), set(), []
        for i, e in enumerate(got_rows):
            k = (e["fromNodeId"], e["toNodeId"])
            if e["id"] not in seen_i and k not in seen_k:
                seen_i.add(e["id"])
                seen_k.add(k)
                want.append(i)
        df = rows(spark, RELATIONSHIP, *[{**e, "lineNumber": i} for i, e in enumerate(got_rows)]).withColumn("pos", F.col("lineNumber").cast("long"))
        assert sorted(x["pos"] for x in dedupe.edges(df).collect()) == want
    calls = rows(spark, RELATIONSHIP, edge("a", "CALLS", "b", lineNumber=10), edge("a", "CALLS", "b", lineNumber=20)).withColumn("pos", F.col("lineNumber").cast("long"))
    assert [x["lineNumber"] for x in dedupe.edges(calls).collect()] == [10]


def test_matching_orientation(spark):
    new = rows(spark, ENDPOINT, node("demo::in", direction="inbound", matchIdentity="HTTP:GET:/u"), node("demo::in", direction="inbound", matchIdentity="HTTP:GET:/u"))
    stored = rows(spark, ENDPOINT, node("x::out", "x", direction="outbound", matchIdentity="HTTP:GET:/u"), node("x::other", "x", direction="outbound", matchIdentity="HTTP:GET:/v"))
    got = [(r["fromNodeId"], r["toNodeId"]) for r in matching.match_edges(new, stored, "demo").collect()]
    assert got == [("x::out", "demo::in")]
    swapped = [(r["fromNodeId"], r["toNodeId"]) for r in matching.match_edges(stored, new, "demo").collect()]
    assert swapped == [("x::out", "demo::in")]


def test_binding_by_name_then_line(spark):
    f = rows(spark, FUNCTION, node("f1", startLine=1, endLine=200), node("f2", startLine=10, endLine=20), node("f3", file="B.java", startLine=1, endLine=9))
    sites = spark.createDataFrame([("a", "src/A.java", 15, None), ("b", "src/A.java", 199, ""), ("c", "src/A.java", 500, None), ("d", "x", 1, "f3")], "site string, projectFilePath string, startLine int, function string")
    assert {r["site"]: r["function"] for r in matching.bind(sites, f).collect()} == {"a": "f1", "b": "f1", "d": "f3"}


def test_validation_codes(spark):
    d = graph(
        spark, pos=True, packages=[node("p", qualifiedName=" ")], units=[node("u"), node("u"), {"id": None}], functions=[node("p")],
        endpoints=[node("e", direction="up"), node("e2", endpointType="HTTP")],
        relationships=[edge("u", "CALLS", "zz", relationshipKind="CALL"), edge("u", "CALLS", "zz", ident="other"), edge("a", "JAVA_X", "b"), edge(None, "CALLS", ""), edge("a", None, "b", ident="t")],
    )
    got = sorted(r["code"] for r in delta.diagnostics(d, spark.createDataFrame([(" ",)], "id string")).collect())
    assert got == sorted([
        "package.qualifiedName.required", "unit.id.duplicate", "unit.id.required", "unit.language.required", "unit.projectName.required", "unit.projectFilePath.required", "unit.qualifiedName.required",
        "node.id.type.conflict", "endpoint.direction.invalid", "endpoint.type.required", "relationship.duplicate", "relationship.from.type.invalid", "relationship.from.type.invalid",
        "relationship.kind.required", "relationship.fromNodeType.required", "relationship.toNodeType.required", "relationship.from.required", "relationship.to.required", "relationship.type.required", "deletedNodeIds.blank",
    ])
    with pytest.raises(delta.Invalid, match="package.qualifiedName.required"):
        delta.apply(graph(spark), d, "demo")


def test_apply_placeholders_and_changes(spark, tmp_path):
    d = graph(
        spark, pos=True, units=[node("unit:A")], functions=[node("fn:demo.Caller.run()", file="src/Caller.java", isPlaceholder=False)],
        endpoints=[node("ep", endpointType="HTTP", direction="inbound", matchIdentity="HTTP:GET:/u")],
        relationships=[edge("fn:demo.Caller.run()", "CALLS", "fn:demo.Service.load(java.lang.String)", lineNumber=10), edge("unit:A", "UNIT_TO_FUNCTION", "fn:demo.Caller.run()"), edge("ep", "MATCHES", "ep")],
    )
    out, events = changes.added(graph(spark), d, "demo")
    s = store.SnapshotStore(spark, str(tmp_path))
    assert s.version() == 0 and s.commit(out) == 1
    got = s.load()
    ph = got.functions.filter("isPlaceholder").first()
    assert (ph["name"], ph["qualifiedName"], ph["signature"], ph["projectName"]) == ("load", "demo.Service.load(java.lang.String)", "load(java.lang.String)", None)
    assert sorted(r["relationshipType"] for r in got.relationships.collect()) == ["CALLS", "UNIT_TO_FUNCTION"]
    assert sorted((r["operation"], r["nodeType"]) for r in events.collect()) == [("INSERT", "CodeEndpoint"), ("INSERT", "CodeFunction"), ("INSERT", "CodeUnit")]
    service = graph(spark, pos=True, functions=[node("fn:demo.Service.load(java.lang.String)", file="src/Service.java", isPlaceholder=False)])
    more = changes.handle(got, "SOURCE_ADDED", "demo", None, service)
    files = spark.createDataFrame([("src/Service.java",)], "path string")
    more = more.with_(relationships=with_defaults(more.relationships))
    assert [r["projectFilePath"] for r in changes.dependents(more, "demo", files).collect()] == ["src/Caller.java"]
    again, _, cascade = changes.modified(more, service, "demo", files)
    assert again.relationships.filter("relationshipType = 'CALLS'").count() == 1
    assert [r["newProjectFilePath"] for r in cascade.collect()] == ["src/Caller.java"]
    gone, _ = changes.removed(more, "demo", files)
    assert gone.relationships.filter("relationshipType = 'CALLS'").count() == 0
    with pytest.raises(ValueError):
        changes.handle(more, "RENAMED", "demo", files)
    assert s.clear() == 2 and s.load().units.count() == 0 and s.load(1).units.count() == 1


def walk(edges, start, depth, way):
    dist = {start: 0}
    for k in range(depth):
        for a, b in edges:
            for x, y in ([(a, b)] if way != "BACKWARD" else []) + ([(b, a)] if way != "FORWARD" else []):
                if dist.get(x) == k and y not in dist:
                    dist[y] = k + 1
    near = lambda v: dist.get(v, 99) < depth
    return dist, {(a, b) for a, b in edges if (way != "BACKWARD" and near(a)) or (way != "FORWARD" and near(b))}


@pytest.mark.parametrize("way", ["FORWARD", "BACKWARD", "BOTH"])
def test_traversal_equals_a_plain_model(spark, way):
    r = random.Random(way)
    pairs = [(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(22)] + [("n1", "n1")]
    df = rows(spark, RELATIONSHIP, *[edge(a, "X", b, ident=f"e{i}") for i, (a, b) in enumerate(pairs)], edge("n1", "Y", "n13"), edge("n1", "X", " "))
    for depth in (1, 2):
        n, e = traverse.traverse(df, "n1", depth, way.lower(), ["X"])
        dist, used = walk(pairs, "n1", depth, way)
        assert {x["node"]: x["depth"] for x in n.collect()} == dist
        assert {(x["fromNodeId"], x["toNodeId"]) for x in e.collect()} == used
    assert traverse.traverse(df, " ")[0].count() == 0


def test_views(spark):
    g = graph(spark, packages=[node("p", file="x")], units=[node("u", gitRepoUrl="r")], endpoints=[node("e", endpointType=None, path="/Users"), node("m", endpointType="MQ", topic="t")], relationships=[edge("u", "X", "e"), edge("u", "X", "zz")])
    got = {r["id"]: r for r in view.nodes(g).collect()}
    assert got["p"]["projectFilePath"] is None and got["e"]["type"] == "ENDPOINT" and got["m"]["path"] == "t"
    assert ids_of(view.search(g, "/uSE")) == ["e"]
    assert ids_of(view.overview(g)[1]) == ["u-X-e"]
    assert ids_of(view.filtered(view.nodes(g), "r", ["UNIT"])) == ["u"]
    assert view.debug(g, "u")[0].count() == 1
    assert sorted(view.with_stubs(view.nodes(g), g.relationships).filter("type = 'CodeElement'").collect()) == [("zz", "CodeElement")]
    assert {(r["kind"], r["value"]) for r in view.metadata(g).collect()} == {("gitRepoUrl", "r"), ("nodeType", "PACKAGE"), ("nodeType", "UNIT"), ("nodeType", "ENDPOINT"), ("nodeType", "MQ"), ("relationshipType", "X")}


def test_json_deltas(spark, tmp_path):
    from codeloom.sources import delta_json

    (tmp_path / "d.json").write_text(json.dumps({"graph": {"units": [{"id": "frontend-demo#u", "projectFilePath": "a.ts", "language": "ts"}], "endpoints": [{"id": "e", "endpointType": "MQ"}], "relationships": [{"id": "r", "fromNodeId": "frontend-demo#u", "toNodeId": "e"}]}}))
    d = delta_json.read(spark, str(tmp_path))
    row = d.first()
    assert (row["scope"]["projectName"], row["scope"]["language"], row["scope"]["sourceFiles"]) == ("frontend-demo", "ts", ["a.ts"])
    assert row["endpoints"][0]["endpointKind"] == "mq"
    g = delta.rescoped(delta_json.tables(d), "frontend-demo")
    assert [r["fromNodeId"] for r in g.relationships.collect()] == ["frontend-demo::frontend-demo#u"]


@pytest.mark.parametrize("streaming", [False, True])
def test_process_parsers(spark, tmp_path, streaming):
    from codeloom.sources import process

    script = tmp_path / "p.py"
    script.write_text("import sys, json\nfor line in sys.stdin:\n    r = json.loads(line)\n    if r.get('bad'):\n        print('no json', flush=True)\n    elif r.get('die'):\n        sys.exit(3)\n    else:\n        print(json.dumps({'units': [{'id': 'u:' + r['f']}]}), flush=True)\n")
    config = process.Config(f"{sys.executable} '{script}'", ("X",), 20, streaming)
    asked = [json.dumps(x) for x in ({"projectName": "demo", "f": "a"}, {"bad": 1, "f": ""}, {"die": 1}, {"projectName": "demo", "f": "b"})]
    got = process.answers(spark.createDataFrame([(x,) for x in asked], "request string").coalesce(1), config)
    assert {r["request"]: r["code"] for r in got.collect()} == dict(zip(asked, [None, "process.protocol", "process.exit", None]))
    d = process.deltas(got)
    assert sorted((r["scope"]["projectName"], r["units"][0]["id"]) for r in d.collect()) == [("demo", "u:a"), ("demo", "u:b")]
    assert process.Registry([config]).find("x") is config
    missing = process.answers(spark.createDataFrame([("{}",)], "request string"), process.Config("/no/such/program"))
    assert missing.first()["code"] == "process.start"


def test_config_scan(spark, tmp_path):
    from codeloom.sources import config_scan

    folder = tmp_path / "m/src/main/resources"
    folder.mkdir(parents=True)
    (folder / "application.properties").write_text("# comment\nusers.base-url=http://users.example\nother : x\n")
    (folder / "application.yml").write_text("users:\n  base-url: 'http://users.example#not-comment' # c\n  deep:\n    a: 1\nlast: \"v\"\n")
    (folder / "bootstrap.yml").write_text("users:\n  base-url: http://override.example\n")
    (folder / "other.yml").write_text("users: no\n")
    got = {r["key"]: r["values"] for r in config_scan.scan(spark, str(tmp_path)).collect()}
    assert got == {"users.base-url": ["http://users.example", "http://users.example#not-comment", "http://override.example"], "other": ["x"], "users.deep.a": ["1"], "last": ["v"]}


def test_java_scan_and_rules(spark, tmp_path):
    from codeloom.sources import endpoint_rules, java_source

    (tmp_path / "A.java").write_text('package demo.web;\n\npublic class A extends Base implements Api {\n    // void no() {}\n    @GetMapping("/api//users/{id}")\n    public String get(@Path String id, int n) {\n        if (n > 0) { return go(id); }\n        return rest.getForObject("${users.url:http://h/v1}/orders/{o}?x=1", String.class);\n    }\n    private static void go(java.util.List<String> x) { }\n}\n')
    (tmp_path / "Base.java").write_text("package demo.web;\nabstract class Base {\n    String get(String id, int n) { return null; }\n}\n")
    (tmp_path / "Api.java").write_text("package demo.web;\npublic interface Api {\n    String get(String id, int n);\n}\n")
    src = java_source.read(spark, str(tmp_path), "demo", str(tmp_path))
    g = java_source.graph(src)
    assert {r["id"] for r in g.functions.filter("projectFilePath = 'A.java'").collect()} == {"fn:demo.web.A.get(String,int)", "fn:demo.web.A.go(java.util.List)"}
    assert {(r["id"], r["unitType"], r["isAbstract"]) for r in g.units.collect()} == {("unit:demo.web.A", "class", False), ("unit:demo.web.Base", "class", True), ("unit:demo.web.Api", "interface", False)}
    kinds = {(r["relationshipType"], r["fromNodeId"], r["toNodeId"]) for r in g.relationships.collect()}
    assert ("JAVA_EXTENDS", "unit:demo.web.A", "unit:demo.web.Base") in kinds and ("JAVA_IMPLEMENTS", "unit:demo.web.A", "unit:demo.web.Api") in kinds
    assert ("JAVA_OVERRIDES", "fn:demo.web.A.get(String,int)", "fn:demo.web.Base.get(String,int)") in kinds
    rules = [endpoint_rules.Rule("in", "HTTP", "inbound", r'@(Get|Post)Mapping\("([^"]*)"\)', 2, 1), endpoint_rules.Rule("out", "HTTP", "outbound", r'getForObject\("([^"]*)"', 1, 0, "GET")]
    got = {r["direction"]: r["matchIdentity"] for r in endpoint_rules.extract(src, rules).collect()}
    assert got == {"inbound": "HTTP:GET:/api/users/{param}", "outbound": "HTTP:GET:/v1/orders/{param}"}
    config = spark.createDataFrame([("users.url", ["http://z/v9"])], "key string, values array<string>")
    assert {r["matchIdentity"] for r in endpoint_rules.extract(src, rules, config).filter("parseLevel = 'config'").collect()} == {"HTTP:GET:/v9/orders/{param}"}
