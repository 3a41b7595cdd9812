"""Set-based mutations of graph tables, and versioned snapshots of a graph.

Every mutation takes and returns DataFrames: an upsert is an anti join and a union, a
delete an anti join. Deleted ids and changed rows are small beside the tables; which
side is broadcast is left to Spark's measured sizes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.dedupe import first_by
from codeloom.operators.keys import less, within, without
from codeloom.operators.lookup import of_project
from codeloom.operators.traverse import written
from codeloom.schema import TABLES, Graph, conform


def upsert(stored: DataFrame, rows: DataFrame, pos: str | None = None) -> DataFrame:
    """Rows replace stored ones of the same id; of rows with the same id the one with the largest pos."""
    if pos:
        rows = first_by(rows.withColumn("_pos", -F.col(pos)), ["id"], "_pos")
    return stored.join(rows.select("id"), "id", "left_anti").unionByName(rows.select(stored.columns))


def upsert_edges(stored: DataFrame, rows: DataFrame, pos: str | None = None) -> DataFrame:
    """As upsert, for edges and other tables much larger than rows: stored rows are shuffled only where their id may be among those of rows."""
    if pos:
        rows = first_by(rows.withColumn("_pos", -F.col(pos)), ["id"], "_pos")
    return without(stored, (rows, ["id"])).unionByName(rows.select(stored.columns))


def update(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """As upsert for rows that are stored in the same project; others are not inserted."""
    known = rows.join(stored.select("id", "projectName"), ["id", "projectName"], "left_semi")
    return upsert(stored, known)


def insert_missing(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds rows whose id is not stored; stored rows stay as they are."""
    return stored.unionByName(without(rows, (stored, ["id"])).select(stored.columns))


def insert_edges(stored: DataFrame, rows: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Upserts edges whose ends both exist."""
    ids = node_ids.select("id").distinct()
    have = rows.join(ids.withColumnRenamed("id", "fromNodeId"), "fromNodeId", "left_semi").join(ids.withColumnRenamed("id", "toNodeId"), "toNodeId", "left_semi")
    return upsert(stored, have)


def delete_nodes(graph: Graph, project: str, gone: DataFrame) -> Graph:
    """Removes units, functions and endpoints of the project with the ids of gone, its edges at them, and its edges with those ids.

    Packages stay, and so do other projects' rows and edges.
    """
    g = written(gone.select("id").distinct()).withColumn("projectName", F.lit(project))
    own, key = ("units", "functions", "endpoints"), ["id", "projectName"]
    out = {t: without(getattr(graph, t), (g, key)) for t in own}
    held = [getattr(graph, t).select(key) for t in own]
    lost = written(within(held[0].unionByName(held[1]).unionByName(held[2]), g, key).distinct())  # only nodes that go take their edges along
    ends = [(lost.withColumnRenamed("id", c), [c, "projectName"]) for c in ("fromNodeId", "toNodeId")]
    rel = without(graph.relationships, (g, key), *ends)
    return graph.with_(**{t: conform(df, TABLES[t]) for t, df in out.items()}, relationships=conform(rel, TABLES["relationships"]))


def delete_edges(relationships: DataFrame, project: str, gone: DataFrame) -> DataFrame:
    """Ids to delete are ids of edges as a rule. gone is read two times or more."""
    return less(relationships, gone.select("id").withColumn("projectName", F.lit(project)), ["id", "projectName"])


def delete_file_calls(relationships: DataFrame, functions: DataFrame, project: str, files: DataFrame) -> DataFrame:
    """Removes the calls made by functions of the files in the column `path`."""
    caller = of_project(functions, project).select(F.col("id").alias("fromNodeId"), F.col("projectFilePath").alias("path"))
    caller = written(within(caller, files.select("path").distinct(), ["path"]).select("fromNodeId"))
    caller = caller.select("fromNodeId", F.lit(project).alias("projectName"), F.lit("CALL").alias("relationshipKind"))
    return without(relationships, (caller, ["fromNodeId", "projectName", "relationshipKind"]))


class Conflict(RuntimeError):
    """Another writer committed the version that this one meant to."""


class SnapshotStore:
    """A graph on shared storage: each commit writes the tables to a new folder, then claims its version by a file.

    The file names the folder and is made only if it does not exist, so of two writers that
    start from one version the later fails and may load and try again. A reader takes the
    last version, so it sees all of a commit or nothing of it.
    """

    LOG = "version long, folder string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _log(self) -> DataFrame:
        path, fs = self._hadoop("versions")
        if not fs.exists(path):
            return self.spark.createDataFrame([], self.LOG)
        files = self.spark.read.text(f"{self.path}/versions", wholetext=True)
        return files.filter("value <> ''").select(F.col("_metadata.file_name").cast("long").alias("version"), F.col("value").alias("folder"))

    def version(self) -> int:
        return self._log().agg(F.max("version")).first()[0] or 0

    def load(self, version: int | None = None) -> Graph:
        from codeloom.schema import empty_graph

        at = self.version() if version is None else version
        row = self._log().filter(F.col("version") == at).first()
        if row is None:
            return empty_graph(self.spark)
        return Graph(**{t: self.spark.read.schema(s).parquet(f"{row['folder']}/{t}").select([f.name for f in s.fields]) for t, s in TABLES.items()})

    def commit(self, graph: Graph, after: int | None = None) -> int:
        """Writes the graph as the version that follows `after` (the one it was loaded from; default: the last)."""
        version, folder = (self.version() if after is None else after) + 1, f"{self.path}/graph-{uuid.uuid4().hex}"
        for name, df in graph.tables().items():
            conform(df, TABLES[name]).write.partitionBy("projectName").parquet(f"{folder}/{name}")
        path, fs = self._hadoop(f"versions/{version:012d}")
        try:
            claim = fs.create(path, False)
        except Exception as e:
            raise Conflict(f"version {version} of {self.path} is taken") from e
        claim.write(bytearray(folder.encode()))
        claim.close()
        return version

    def clear(self) -> int:
        from codeloom.schema import empty_graph

        return self.commit(empty_graph(self.spark))
