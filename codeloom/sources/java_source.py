"""A set-based scan of Java sources: packages, types, methods, calls and their edges.

Sources are read whole, one row a file. What a file tells by itself is told by one pass over
it (java_file): its declarations, its calls, the supertypes that it declares itself, and the
callees in the types around a call. What remains are joins between files, of the rows that
another file may answer.

It covers package and import declarations; classes, interfaces, enums, records and
annotation types, nested ones included; methods and constructors with modifiers,
parameter types and lines; extends and implements; overrides along all supertypes of the
scan; and calls by simple name and number of arguments: of the caller's own type or the next
around it that has such a method, else of the one method of the project that fits, else none. A simple type
name means a type of the same file, else package, else an imported one, else none. Local
and anonymous classes are no units; calls inside them belong to the method around them. It
resolves no overloads by type: for bindings of that kind, import deltas from a compiler
front end (sources.process).

Defined results: a null or empty source gives no rows, nor does a file without a path or project; brackets that do not close reach to
the file's end and have no end line; repeated declarations are kept once by later keep-first.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import ids
from codeloom.operators.dedupe import first_by
from codeloom.operators.keys import FEW, possible, repeated
from codeloom.operators.traverse import release, written
from codeloom.schema import ENDPOINT, FUNCTION, PACKAGE, RELATIONSHIP, UNIT, Graph, conform
from codeloom.sources import java_file

_FILE = ["projectName", "file"]
#: Files that a task matches; by bytes there would be a few tasks only, as matching costs far more than reading.
TASK_FILES = 2**12


def read(spark: SparkSession, path: str, project: str, root: str = "") -> DataFrame:
    """(file, source, raw, projectName) of all .java files below path; raw is for rules over the text, and the same."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").text(path, wholetext=True)
    at = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    return rows.select(ids.project_file_path(F.lit(None).cast("string"), F.lit(root), at).alias("file"), F.col("value").alias("source"), F.col("value").alias("raw"), F.lit(project).alias("projectName"))


class Scan:
    """types, methods and calls of the scanned files, and the files themselves."""

    def __init__(self, files: DataFrame):
        self.files = files

    def _each(self, column: str, *more: str) -> DataFrame:
        return self.files.select(*_FILE, *more, F.explode(column).alias("x")).select(*_FILE, *more, "x.*")

    @cached_property
    def types(self) -> DataFrame:
        return self._each("types", "package")

    @cached_property
    def methods(self) -> DataFrame:
        return self._each("methods")

    @cached_property
    def calls(self) -> DataFrame:
        """The first of each method by name, number of arguments and `new`."""
        return self._each("calls")

    @cached_property
    def bases(self) -> DataFrame:
        return self._each("bases", "package")


def scan(rows: DataFrame) -> Scan:
    """Declarations and calls of (projectName, file, source)."""
    plain = written(rows.filter("projectName IS NOT NULL AND file IS NOT NULL").select(*_FILE, "source"))  # counted and dealt
    tasks = max(plain.sparkSession.sparkContext.defaultParallelism, -(-plain.count() // TASK_FILES))
    found = written(plain.repartition(tasks, *_FILE).mapInArrow(java_file.scanned, java_file.SCHEMA))
    release(plain)
    return Scan(found)


def _asked(df: DataFrame, on: list[str], asked: DataFrame) -> DataFrame:
    """df's rows whose columns `on` may be those of a row of asked: joins of these need no other rows."""
    h = F.xxhash64(*on)
    wanted = written(asked.select(h.alias("_h")).distinct())
    n = wanted.count()
    return df.limit(0) if n == 0 else possible(df, h, wanted, n) if n <= FEW else df


def resolved(found: Scan, up: bool) -> DataFrame:
    """(project, qualified, target) of the types that extend (up) or implement a type of the scan: one of the file, else of its package, else an imported one."""
    wanted = found.bases.filter(F.col("up") == up).drop("up")
    columns = ["projectName", "qualified", "target"]
    far = wanted.filter("target IS NULL").drop("target")
    here = ["projectName", "package", "x"]
    near = found.types.select("projectName", "package", F.col("name").alias("x"), F.col("qualified").alias("target"))
    near = written(_asked(near, here, far).groupBy(*here).agg(F.min("target").alias("target")))
    far = far.join(near, here, "left")
    named = far.filter("target IS NULL").select(*_FILE, "qualified", "x", F.explode("imports").alias("target"))
    known = found.types.select("projectName", F.col("qualified").alias("target"))
    known = written(_asked(known, ["projectName", "target"], named).distinct())
    imported = named.join(known, ["projectName", "target"]).groupBy(*_FILE, "qualified", "x").agg(F.min("target").alias("target"))
    every = wanted.filter("target IS NOT NULL").select(columns).unionByName(far.filter("target IS NOT NULL").select(columns)).unionByName(imported.select(columns))
    return every.filter("qualified <> target").distinct()


def supertypes(found: Scan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(extends, implements, all): edges (project, qualified, target) between types of the scan; all is transitive."""
    up, like = written(resolved(found, True)), written(resolved(found, False))
    direct = written(up.unionByName(like).distinct())
    every = step = direct
    on = ["projectName", "target"]
    while True:
        further = written(_asked(direct.select("projectName", F.col("qualified").alias("target"), F.col("target").alias("next")), on, step))
        ahead = step.join(further, on).select("projectName", "qualified", F.col("next").alias("target")).distinct()
        step = written(ahead.join(every, ["projectName", "qualified", "target"], "left_anti"))
        if step.isEmpty():
            return up, like, every
        every = every.unionByName(step)


def overrides(found: Scan, every: DataFrame) -> DataFrame:
    """(full, up) of methods with the signature of one of a supertype; every: all supertypes (project, qualified, target)."""
    named = found.methods.filter("NOT isConstructor AND NOT array_contains(modifiers, 'static') AND NOT array_contains(modifiers, 'private')").select("projectName", "qualified", "signature", "full")
    # Methods of supertypes are few as a rule, and so are others with the signature of one.
    above = named.select("projectName", F.col("qualified").alias("target"), "signature", F.col("full").alias("up"))
    above = written(_asked(above, ["projectName", "target"], every).distinct())
    own = _asked(named, ["projectName", "signature"], above).distinct()
    return every.join(own, ["projectName", "qualified"]).join(above, ["projectName", "target", "signature"])


def _shared(found: Scan) -> DataFrame | None:
    """Files with a call whose type, or a type around it, has methods in another file too; None if there is none."""
    h = F.xxhash64("projectName", "of").alias("_h")
    of = lambda column: found.files.select(*_FILE, F.explode(column).alias("of"))
    owners = of("owners").select("projectName", "of")
    again, _ = repeated(owners, h)
    outside = written(of("outside").select(h).distinct())
    n = outside.count()
    hit = (possible(owners, h, outside, n) if 0 < n <= FEW else owners if n else owners.limit(0)).select(h).join(outside, "_h", "left_semi")
    hashes = written(again.unionByName(hit).distinct())
    n = hashes.count()
    if n == 0:
        return None
    touched = of(F.concat("owners", "outside")).withColumn("_h", h)
    touched = possible(touched, F.col("_h"), hashes, n) if n <= FEW else touched
    return written(touched.join(hashes, "_h", "left_semi").select(_FILE).distinct())


def _around(calls: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls with `callee`, the one method that fits in the first type around that has such, and calls for which no type around has one."""
    key = ["projectName", "name", "n_args"]
    m = _asked(methods.select(*key, "of", "callee"), key, calls).groupBy(*key, "of").agg(F.min("callee").alias("callee"), F.count("*").alias("n"))
    # The caller's own type and those around it, innermost first.
    parts = F.split("qualified", r"\.")
    around = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    near = calls.select("*", F.posexplode(around).alias("far", "of")).join(m, [*key, "of"])
    near = near.groupBy(*calls.columns).agg(F.min_by(F.struct("callee", "n"), "far").alias("best"))
    own = near.filter("best.n = 1").withColumn("callee", F.col("best.callee")).drop("best")
    return own, calls.join(near.select(*key, "qualified").distinct(), [*key, "qualified"], "left_anti")


def call_targets(found: Scan) -> DataFrame:
    """(project, file, full, callee, line) of the calls whose target is told by name and number of arguments; first line of each pair."""
    key = ["projectName", "name", "n_args"]
    every = found.methods.select(*key, F.col("qualified").alias("of"), F.col("full").alias("callee"), "isConstructor")
    m, made = every.filter("NOT isConstructor"), every.filter("isConstructor")

    def only(methods: DataFrame, calls: DataFrame) -> DataFrame:
        """calls with the one method that fits."""
        one = _asked(methods, key, calls).groupBy(*key).agg(F.min("callee").alias("callee"), F.count("*").alias("n")).filter("n = 1").drop("n")
        return calls.join(written(one), key)

    columns = [*_FILE, "full", "callee", "line", "name"]
    rows = [*_FILE, "full", "qualified", "line", "name", "n_args"]
    plain, shared = found.calls.filter("NOT creates"), _shared(found)
    local = plain if shared is None else plain.join(shared, _FILE, "left_anti")
    # What is around a call is known to its file, unless another one declares the same type.
    own, rest = local.filter("callee IS NOT NULL").select(columns), local.filter("NOT near").select(rows)
    if shared is not None:
        others, further = _around(plain.join(shared, _FILE, "left_semi").select(rows), m)
        own, rest = own.unionByName(others.select(columns)), rest.unionByName(further)
    plain = own.unionByName(only(m, rest).select(columns))
    new = only(made, found.calls.filter("creates").select(rows)).select(columns)
    # A file's calls differ by name or arguments, so they have different targets, but a method may be named like a constructor.
    parts = F.split(F.substring_index("callee", "(", 1), r"\.")
    like = F.element_at(parts, -2) == F.col("name")
    again = plain.filter(like).unionByName(new).groupBy(*_FILE, "full", "callee").agg(F.min("line").alias("line"))
    return plain.filter(~like).drop("name").unionByName(again)


def graph(rows: DataFrame, git_url: str | None = None, branch: str | None = None) -> Graph:
    """The scanned files as graph tables with pos, unscoped ids as a delta has them."""
    found = scan(rows)
    node = {"language": F.lit("java"), "gitRepoUrl": F.lit(git_url).cast("string"), "gitBranch": F.lit(branch).cast("string")}
    t = found.types.withColumn("pos", F.xxhash64("file", "qualified"))
    m = found.methods.withColumn("pos", F.xxhash64("file", "full"))
    file = F.col("file").alias("projectFilePath")
    pkg = first_by(t.filter("package <> ''").select("package", "projectName", "file", "pos"), ["package", "projectName"], "pos")
    packages = pkg.select(
        ids.package_id(F.col("package")).alias("id"), F.element_at(F.split("package", r"\."), -1).alias("name"), F.col("package").alias("qualifiedName"), "projectName",
        ids.parent_directory(F.col("file")).alias("projectFilePath"), ids.package_path(F.col("package")).alias("packagePath"), "pos",
    )
    units = t.select(
        ids.unit_id(F.col("qualified")).alias("id"), "name", F.col("qualified").alias("qualifiedName"), "projectName", file, "startLine", "endLine", "unitType", "modifiers",
        F.array_contains("modifiers", "abstract").alias("isAbstract"), F.when(F.col("package") != "", ids.package_id(F.col("package"))).alias("packageId"), "pos",
    )
    functions = m.select(
        ids.function_id(F.col("full")).alias("id"), "name", F.col("full").alias("qualifiedName"), "projectName", file, "startLine", "endLine", "signature", "returnType", "modifiers",
        F.array_contains("modifiers", "static").alias("isStatic"), "isConstructor", F.lit(False).alias("isPlaceholder"), "pos",
    )

    def edges(df: DataFrame, a: Column, kind: str, b: Column, label: str, ends: tuple[str, str], line: Column | None = None) -> DataFrame:
        return df.select(
            ids.relationship_id(a, F.lit(kind), b).alias("id"), a.alias("fromNodeId"), b.alias("toNodeId"), F.lit(kind).alias("relationshipType"), F.lit(label).alias("relationshipKind"),
            F.lit(ends[0]).alias("fromNodeType"), F.lit(ends[1]).alias("toNodeType"), (F.lit(None) if line is None else line).cast("int").alias("lineNumber"),
            (F.lit("direct") if kind == "CALLS" else F.lit(None)).cast("string").alias("callType"), "projectName", F.lit("java").alias("language"), F.xxhash64(a, b).alias("pos"),
        )

    unit, fn = ids.unit_id(F.col("qualified")), ids.function_id(F.col("full"))
    both, whole = ("CodeFunction", "CodeFunction"), ("CodeUnit", "CodeUnit")
    up, like, every = supertypes(found)
    over = overrides(found, every)
    faces = found.types.filter("unitType = 'interface'").select("projectName", "qualified")
    parts = [
        edges(t.filter("package <> ''"), ids.package_id(F.col("package")), "PACKAGE_TO_UNIT", unit, "CONTAINS", ("CodePackage", "CodeUnit")),
        edges(m, unit, "UNIT_TO_FUNCTION", fn, "CONTAINS", ("CodeUnit", "CodeFunction")),
        edges(up, unit, "JAVA_EXTENDS", ids.unit_id(F.col("target")), "SPECIALIZES", whole),
        edges(like.join(faces, ["projectName", "qualified"], "left_anti"), unit, "JAVA_IMPLEMENTS", ids.unit_id(F.col("target")), "CONFORMS", whole),
        edges(over, fn, "JAVA_OVERRIDES", ids.function_id(F.col("up")), "REFINES", both),
        edges(call_targets(found), fn, "CALLS", ids.function_id(F.col("callee")), "CALL", both, F.col("line")),
    ]
    rel = reduce(DataFrame.unionByName, parts)
    none = rows.sparkSession.createDataFrame([], ENDPOINT).withColumn("pos", F.lit(0).cast("long"))
    more = lambda df, schema: conform(df.withColumns(node), schema, "pos")
    return Graph(more(packages, PACKAGE), more(units, UNIT), more(functions, FUNCTION), none, conform(rel, RELATIONSHIP, "pos"))
