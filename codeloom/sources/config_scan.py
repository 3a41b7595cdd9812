"""Values of application configuration files, as rows of key, value, file and place.

Files are found by name below any src/main/resources folder and read as text by Spark;
lines become rows, and nested YAML keys are built by window functions over a file's
lines, whose number is that of a configuration file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_DEPTH = 8
#: Fixed value: paths of the files that are read.
FILES = r"/src/main/resources/(?:[^/]+/)*(?:application|bootstrap)[^/]*\.(?:properties|ya?ml)$"


#: What a project's root folder holds.
MARKERS = ("pom.xml", "build.gradle", "settings.gradle", "src/main/resources")


def project_root(spark: SparkSession, path: str, relative: str | None = None) -> str | None:
    """The root of a file's project: as many folders up as its path in the project has parts, else the first with a marker; None without one."""
    parts = path.rstrip("/").split("/")
    if relative and relative.strip("/"):
        up = parts[: -len(relative.strip("/").split("/"))]
        return "/".join(up) or "/"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for n in range(len(parts) - 1, 0, -1):  # as many steps as the path has folders
        folder = "/".join(parts[:n]) or "/"
        for marker in MARKERS:
            at = hadoop(f"{folder.rstrip('/')}/{marker}")
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                return folder
    return None


def _unquoted(v: Column) -> Column:
    v = F.trim(v)
    return F.when(v.rlike(r"^\".*\"$") | v.rlike(r"^'.*'$"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, pos, line) of the files at most MAX_DEPTH folders below root."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{properties,yml,yaml}").text(root, wholetext=True)
    files = files.select(F.col("value"), F.col("_metadata.file_path").alias("path")).filter(F.col("path").rlike(FILES))
    below = F.size(F.split(F.col("path"), "/")) - F.size(F.split(F.lit(root.rstrip("/")), "/"))
    return files.filter(below <= MAX_DEPTH + 2).select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def values(rows: DataFrame) -> DataFrame:
    """(key, value, path, pos) from (path, pos, line)."""
    is_yaml = F.col("path").rlike(r"\.ya?ml$")
    text = F.regexp_replace("line", r"^\s*[#!].*$", "")
    props = rows.filter(~is_yaml).select("path", "pos", F.regexp_extract(text, r"^\s*([^=:\s]+)\s*[=:]\s*(.*)$", 1).alias("key"), F.trim(F.regexp_extract(text, r"^\s*([^=:\s]+)\s*[=:]\s*(.*)$", 2)).alias("value")).filter("key <> ''")
    bare = F.regexp_replace(F.regexp_replace("line", r"^\s*#.*$", ""), r"^((?:[^'\"#]|'[^']*'|\"[^\"]*\"|(?<=\S)#)*?)\s+#.*$", "$1")
    y = rows.filter(is_yaml).withColumn("text", bare).filter(F.col("text").rlike(r"^\s*[^\s:#-][^:]*:(?:\s|$)"))
    y = y.select("path", "pos", F.length(F.regexp_extract("text", r"^(\s*)", 1)).alias("indent"), F.trim(F.regexp_extract("text", r"^\s*([^:]+):", 1)).alias("name"), F.trim(F.regexp_extract("text", r"^\s*[^:]+:\s*(.*)$", 1)).alias("value"))
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    y = y.withColumn("seen", F.collect_list(F.struct("indent", "name")).over(before))
    # Parents: going back, each line indented less than all kept so far.
    up = F.aggregate(F.reverse("seen"), F.struct(F.lit(1 << 20).alias("at"), F.array().cast("array<string>").alias("names")), lambda a, x: F.when(x["indent"] < a["at"], F.struct(x["indent"].alias("at"), F.concat(F.array(_unquoted(x["name"])), a["names"]).alias("names"))).otherwise(a))
    yaml = y.filter("value <> ''").select("path", "pos", F.array_join(up["names"], ".").alias("key"), _unquoted(F.col("value")).alias("value"))
    return props.unionByName(yaml).select("key", "value", "path", "pos")


def merged(found: DataFrame) -> DataFrame:
    """(key, values): a key's values in the order of files and lines."""
    return found.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "pos", "value"))), lambda x: x["value"]).alias("values"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    return merged(values(lines(spark, root)))
