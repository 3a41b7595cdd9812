"""What several corpus operators share: scratch tables, bounded key filters, components."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest key filter: 2**25 bits, 524,288 rows of (word, bits). Beyond it the
#: filter lets more rows through; the join that follows stays exact.
MAX_FILTER_BITS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (tests) a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
        base = sc.getCheckpointDir()
    return f"{base}/codeloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a materialized table that no later plan reads."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Columns that an operator adds for a while to a caller's rows start with __codeloom_.


class KeyFilter:
    """A bitmap of hashed keys in one or a few MB, broadcast to drop rows before a shuffle.

    Rows it passes may be false positives, rows it drops are never members, so an
    exact join afterwards gives the same result with or without it. Its size is
    2**bits with bits <= MAX_FILTER_BITS whatever the number of keys.
    """

    def __init__(self, keys: DataFrame, key: Column):
        self.count = keys.count()
        self.bits = min(MAX_FILTER_BITS, max(16, math.ceil(math.log2(8 * (self.count + 1)))))
        at = keys.select(self._slot(key).alias("__codeloom_p"))
        self.words = at.groupBy(F.shiftright("__codeloom_p", 6).alias("__codeloom_w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(__codeloom_p & 63 as int))")).alias("__codeloom_bits")
        )

    def _slot(self, key: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key), 64 - self.bits)

    def mark(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """df with a boolean column: false means surely not among the keys."""
        marked = df.withColumn("__codeloom_p", self._slot(key)).withColumn("__codeloom_w", F.shiftright("__codeloom_p", 6))
        marked = marked.join(F.broadcast(self.words), "__codeloom_w", "left")
        hit = F.coalesce(F.expr("getbit(__codeloom_bits, cast(__codeloom_p & 63 as int))"), F.lit(0)) == 1
        return marked.withColumn(name, hit).drop("__codeloom_p", "__codeloom_w", "__codeloom_bits")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges over long ids: (node, label), label the smallest id.

    Every round hooks each node to its smallest neighbour, jumps twice along the
    pointers and contracts the edges, so the edge table shrinks geometrically. Each
    round is written to the shared folder; a hub costs one partial minimum a task.
    Nodes without edges are not listed. Loops and repeated edges change nothing.
    """
    e = edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
    e = materialize(e.filter("a < b").distinct(), "edges")
    labels = None
    while not e.isEmpty():
        near = e.select(F.col("a").alias("node"), F.col("b").alias("x")).unionByName(
            e.select(F.col("b").alias("node"), F.col("a").alias("x"))
        )
        hook = materialize(
            near.groupBy("node").agg(F.min("x").alias("x")).select("node", F.least("node", "x").alias("up")), "hook"
        )
        jump = hook.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        for _ in range(2):
            hook = hook.join(jump, "up").select("node", F.col("up2").alias("up"))
        hook = materialize(hook, "up")
        if labels is None:
            labels = hook.select("node", F.col("up").alias("label"))
        else:
            up = hook.select(F.col("node").alias("label"), "up")
            labels = materialize(
                labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels"
            )
        ha, hb = hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), hook.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        last = e
        e = e.join(ha, "a").join(hb, "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
        e = materialize(e.filter("a < b").distinct(), "edges")
        release(last)
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def without_keys(df: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """df without the rows whose key is in the one column of keys; only possible members are shuffled."""
    name = keys.columns[0]
    keys = keys.select(F.col(name).alias("__codeloom_gone"))
    marked = KeyFilter(keys, F.col("__codeloom_gone")).mark(df.withColumn("__codeloom_key", key), F.col("__codeloom_key"), "__codeloom_maybe")
    maybe = marked.filter("__codeloom_maybe").join(keys, F.col("__codeloom_key") == F.col("__codeloom_gone"), "left_anti")
    return marked.filter(~F.col("__codeloom_maybe")).select(df.columns).unionByName(maybe.select(df.columns))
