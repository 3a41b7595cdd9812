"""What a Java file tells by itself is told in one pass over it; joins answer the rest, also where types are declared more than once."""

from codeloom.sources import java_source
from codeloom.sources.java_source import call_targets, scan, supertypes

LOCAL = "package p;\nclass A extends B implements I, J {\n  void f() { g(1); g(1); new A(); h(2); other(3); }\n  void g(int a) { }\n  A() { }\n  static class In { void k() { g(4); f(); } }\n}\ninterface I { }\n"
OTHER = "package p;\nclass B { void other(int x) { } void h(int a) { } void h(long a) { } }\n"


def rows(spark, *files):
    return spark.createDataFrame([("s", f"{i}.java", text) for i, text in enumerate(files)], "projectName string, file string, source string")


def calls(found):
    return sorted((r["full"], r["callee"], r["line"]) for r in call_targets(found).collect())


def test_calls_that_a_file_answers_are_in_no_join(spark):
    """each call was joined with the methods of all types around it, and every token was dealt to windows and joins."""
    found = scan(rows(spark, LOCAL, OTHER))
    plan = call_targets(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Window" not in found.methods._jdf.queryExecution().optimizedPlan().toString()
    assert calls(found) == [("p.A.In.k()", "p.A.f()", 6), ("p.A.In.k()", "p.A.g(int)", 6), ("p.A.f()", "p.A.A()", 3), ("p.A.f()", "p.A.g(int)", 3), ("p.A.f()", "p.B.other(int)", 3)]


def test_types_declared_in_several_files(spark):
    """Calls of a type that another file declares too, or that is around it, are answered by the methods of all files."""
    again = "package p;\nclass A { void other(int x) { } void g(int b) { } }\n"
    outer = "class p { void h(int a) { } }\n"
    found = scan(rows(spark, LOCAL, OTHER, again, outer))
    assert calls(found) == [("p.A.In.k()", "p.A.f()", 6), ("p.A.f()", "p.A.A()", 3), ("p.A.f()", "p.A.other(int)", 3), ("p.A.f()", "p.h(int)", 3)]


def test_a_method_named_like_a_constructor_is_one_target(spark):
    text = "package p;\nclass A {\n  A(int a) { }\n  void A(int a) { }\n  void f() {\n    A(1);\n    new A(2);\n  }\n}\n"
    assert calls(scan(rows(spark, text))) == [("p.A.f()", "p.A.A(int)", 6)]


def test_supertypes_of_file_package_and_imports(spark):
    """A type of the file comes first, then one of the package, then an imported one; of several the first by name."""
    a = "package p;\nimport q.C;\nimport r.C;\nimport q.D;\nclass A extends C { static class B { } }\nclass E extends B { }\nclass F extends D implements G { }\n"
    found = scan(rows(spark, a, "package q; class C { } class D { }", "package r; class C { }", "package p; class D { static class G { } } class B { }"))
    up, like, every = (sorted((r["qualified"], r["target"]) for r in df.collect()) for df in supertypes(found))
    assert up == [("p.A", "q.C"), ("p.E", "p.A.B"), ("p.F", "p.D")]
    assert like == [("p.F", "p.D.G")]
    assert every == sorted(up + like)


def test_line_ends_of_other_systems(spark):
    text = "package p;\r\nimport q.C;\r\nclass A extends C {\r\n  void f(final int a,\r\n    String b\r\n  ) { /* x\r\n */ }\r\n}\r\n"
    found = scan(rows(spark, text))
    m = found.methods.first()
    assert (m["args"], m["last_parameter"], m["startLine"], m["endLine"]) == (["int", "String"], "b", 4, 7)
    assert [(r["x"], r["imports"]) for r in found.bases.collect()] == [("C", ["q.C"])]


def test_files_without_a_path_or_project_have_no_rows(spark):
    files = spark.createDataFrame([(None, "a.java", LOCAL), ("s", None, LOCAL), ("s", "b.java", OTHER)], "projectName string, file string, source string")
    assert {r["file"] for r in java_source.scan(files).types.collect()} == {"b.java"}
