"""The Java scan on sources that try to mislead it, and the filters of calls."""

from pyspark.sql import functions as F

from codeloom.operators import filters
from codeloom.sources import java_source

A = '''package demo.a;

import demo.b.Helper;
import java.util.*;

/* class Not { void no() {} } */
@Deprecated
public abstract class Service<T extends Comparable<T>> extends Base implements demo.b.Api<T>, Runnable {
    static final String PATH = "/api/**"; // } {
    private final Map<String, List<Integer>> seen = new HashMap<>();
    char brace = '{', quote = '\\'', back = '\\\\';

    Service(final Map<String, List<T>> in, @Named("x, y") int... rest) throws java.io.IOException {
        super(in);
        this.seen.put("a,b", size(rest));
    }

    public boolean isOpen() { return this.open; }
    public String getName() { return name; }
    public String getUpper() { return name.toUpperCase(); }
    public void setName(String name) { this.name = name; }

    public <R> List<R> run(List<? super T> in, int n) {
        Runnable r = new Runnable() {
            public void run() { help(1, in); }
        };
        if (n > 0) { help(2, new int[] {1, 2, 3}); } else help(f(n, 1), "x");
        for (int i = 0; i < n; i++) { Helper.of(i); }
        String text = """
            class Fake { void fake() { } }
            """;
        return new Inner(n).done();
    }

    private void help(int a, Object b) { }
    abstract int size(int[] x);

    static class Inner {
        Inner(int n) { help(n, n); }
        <R> List<R> done() { return null; }
        enum Kind { ONE(1) { int two() { return 2; } }, TWO(2); Kind(int i) { } }
    }
}

class Second {
    void four() { new Service.Inner(4); }
}
'''
B = '''package demo.b;
public interface Api<T> { int size(int[] x); default void log() { } }
class Helper { static void of(int i) { } static void of(long a, long b) { } }
'''
BASE = "package demo.a;\nclass Base implements Root { public int size(int[] x) { return 0; } }\ninterface Root { int size(int[] x); }\n"
OTHER = "package demo.c;\nclass Base { }\nclass User extends Base { void log(int level) { } }\n"


def rows(spark):
    files = [("p", "a/Service.java", A), ("p", "b/Api.java", B), ("p", "a/Base.java", BASE), ("p", "c/Base.java", OTHER), ("p", "Empty.java", ""), ("p", "Null.java", None), ("p", "Broken.java", "class Broken { void cut() { if (")]
    return spark.createDataFrame(files, "projectName string, file string, source string")


def test_types_and_methods_of_every_type(spark):
    found = java_source.scan(rows(spark))
    types = {r["qualified"]: r for r in found.types.collect()}
    assert set(types) == {"demo.a.Service", "demo.a.Service.Inner", "demo.a.Service.Inner.Kind", "demo.a.Second", "demo.b.Api", "demo.b.Helper", "demo.a.Base", "demo.a.Root", "demo.c.Base", "demo.c.User", "Broken"}
    s = types["demo.a.Service"]
    assert (s["modifiers"], s["extends"], s["implements"], s["startLine"], s["endLine"]) == (["public", "abstract"], ["Base"], ["Api", "Runnable"], 8, 43)
    assert types["demo.a.Service.Inner.Kind"]["unitType"] == "enum" and types["Broken"]["endLine"] is None
    full = {r["full"]: r for r in found.methods.filter("file = 'a/Service.java'").collect()}
    assert set(full) == {
        "demo.a.Service.Service(Map,int...)", "demo.a.Service.isOpen()", "demo.a.Service.getName()", "demo.a.Service.getUpper()", "demo.a.Service.setName(String)",
        "demo.a.Service.run(List,int)", "demo.a.Service.help(int,Object)", "demo.a.Service.size(int[])", "demo.a.Service.Inner.Inner(int)", "demo.a.Service.Inner.done()",
        "demo.a.Service.Inner.Kind.Kind(int)", "demo.a.Second.four()",
    }
    run = full["demo.a.Service.run(List,int)"]
    assert (run["startLine"], run["endLine"], run["returnType"], run["modifiers"]) == (23, 33, "List<R>", ["public"])
    assert full["demo.a.Service.size(int[])"]["endLine"] == 36


def test_calls_by_name_and_number_of_arguments(spark):
    g = java_source.graph(rows(spark))
    calls = {(r["fromNodeId"].removeprefix("fn:demo."), r["toNodeId"].removeprefix("fn:demo."), r["lineNumber"]) for r in g.relationships.filter("relationshipType = 'CALLS'").collect()}
    assert calls == {
        ("a.Service.Service(Map,int...)", "a.Service.size(int[])", 15), ("a.Service.run(List,int)", "a.Service.help(int,Object)", 25),
        ("a.Service.run(List,int)", "b.Helper.of(int)", 28), ("a.Service.run(List,int)", "a.Service.Inner.Inner(int)", 32), ("a.Service.run(List,int)", "a.Service.Inner.done()", 32),
        ("a.Service.Inner.Inner(int)", "a.Service.help(int,Object)", 39), ("a.Second.four()", "a.Service.Inner.Inner(int)", 46),
    }


def test_supertypes_by_package_and_import_and_overrides_along_them(spark):
    g = java_source.graph(rows(spark))
    edges = {(r["relationshipType"], r["fromNodeId"].partition(":")[2], r["toNodeId"].partition(":")[2]) for r in g.relationships.filter("relationshipType LIKE 'JAVA%'").collect()}
    assert edges == {
        ("JAVA_EXTENDS", "demo.a.Service", "demo.a.Base"), ("JAVA_EXTENDS", "demo.c.User", "demo.c.Base"), ("JAVA_IMPLEMENTS", "demo.a.Base", "demo.a.Root"),
        ("JAVA_OVERRIDES", "demo.a.Service.size(int[])", "demo.a.Base.size(int[])"), ("JAVA_OVERRIDES", "demo.a.Service.size(int[])", "demo.a.Root.size(int[])"),
        ("JAVA_OVERRIDES", "demo.a.Base.size(int[])", "demo.a.Root.size(int[])"),
    }


def test_no_sources(spark):
    g = java_source.graph(rows(spark).limit(0))
    assert all(df.count() == 0 for df in g.tables().values())


def test_filters_of_calls(spark):
    m = java_source.scan(rows(spark)).methods
    args = (F.col("name"), F.col("args"), F.col("returnType"))
    names = lambda df: {r["name"] for r in df.select("name").collect()}
    own = m.filter("qualified = 'demo.a.Service'")
    assert names(own.filter(filters.accessor(*args))) == {"isOpen", "getName", "getUpper", "setName"}
    assert names(own.filter(filters.trivial_accessor(*args, F.col("body"), F.col("last_parameter")))) == {"isOpen", "getName", "setName"}
    odd = [("get", [], "int"), ("getx", [], "int"), ("getX", [], "void"), ("getX", [], None), ("getX", ["int"], "int"), ("isX", [], "int"), ("isX", [], "Boolean"), ("setX", ["int"], "int"), ("setX", ["int"], "void"), ("setX", [], "void"), ("settle", ["int"], "void")]
    df = spark.createDataFrame(odd, "name string, args array<string>, returnType string")
    assert [r["x"] for r in df.select(filters.accessor(*args).alias("x")).collect()] == [False, False, False, False, False, False, True, False, True, False, False]
    targets = spark.createDataFrame([("a.B", True), ("com.x.C", False), ("com.xy.D", False), ("java.util.List", False), (None, True)], "q string, own boolean")
    kept = filters.pipeline(targets, filters.from_source_or_listed(F.col("own"), F.col("q"), ["com.x"]))
    assert {r["q"] for r in kept.collect()} == {"a.B", "com.x.C", "com.xy.D"} and filters.pipeline(targets).count() == 5
